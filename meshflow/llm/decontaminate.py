"""Benchmark decontamination by suffix arrays of the training text.

Each shard (a slab of documents) builds a suffix array over its words and every benchmark suffix that
can start a window is binary-searched in it, one word at a time. Each occurrence is then followed to the
end of its verbatim match, whose longest one, with its item and place, is returned beside the words in
windows. A window is `window` consecutive words of one item; an item of fewer words, but not none, is one
window. Words that can't be part of an occurrence are left out of the suffix array: only runs of benchmark
words that are as long as the shortest window stay, which loses no match.

Words are looked up by 64-bit hashes, and those in an occurrence are then compared byte by byte: an
occurrence that doesn't hold is left out (benchmark words that share a hash are told apart by their bytes,
the first of them keeping it; that the others are then not found takes a collision among benchmark words).

Benchmark items are shipped to the tasks in blocks of bounded bytes. All blocks are searched in one pass,
in which only the texts go to Python, and nothing is shuffled.

Defined results: null and empty texts have no words and no hits. Items without words, and items whose
id is null, never match. Items that share an id count once. Repeated document rows give repeated rows.
Of longest matches of equal length the one with the least first word, then item, counts. Very long texts
are slabs of their own. Empty tables give an empty result, or no hits. Other columns of either table are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .slabs import ranges, slabs, text_bytes, word_hashes, words

WINDOW = 10
#: Bytes of benchmark text that are sent to each task at once.
BLOCK_BYTES = 16 << 20


@dataclass
class Suffixes:
    """Benchmark words as numbers from 1, item after item, with the suffixes that start a window."""

    names: list[str]
    vocabulary: np.ndarray
    spelling: np.ndarray  # bytes of the vocabulary's words
    spelt: np.ndarray  # where each of them starts
    seq: np.ndarray
    start: np.ndarray  # of each searched suffix
    need: np.ndarray  # words of its window
    room: np.ndarray  # words up to the end of its item
    item: np.ndarray


def benchmark_suffixes(items: list[tuple[str, str | None]], window: int = WINDOW) -> Suffixes:
    items = [(k, t) for k, t in items if k is not None and t]
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    low, starts, ends, row = words(data, offsets)
    vocabulary, shown, seq = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    spelt = np.concatenate([[0], np.cumsum(ends[shown] - starts[shown])]).astype(np.int64)
    spelling = low[ranges(starts[shown], ends[shown] - starts[shown])] if len(shown) else low[:0]
    if len(seq):
        seq[~same_words(low, starts, ends, spelling, spelt[seq], spelt[seq + 1])] = len(vocabulary)
    n = np.bincount(row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64) if len(items) else np.zeros(0, np.int64)
    at = ranges(first, np.where(n >= window, n - window + 1, np.minimum(n, 1)))
    of = row[at] if len(at) else np.zeros(0, np.int64)
    return Suffixes([k for k, _ in items], vocabulary, spelling, spelt, seq.astype(np.int64) + 1, at, np.minimum(n[of], window), first[of] + n[of] - at, of)


def same_words(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the words a[a_start:a_end] and b[b_start:b_end] have the same bytes."""
    same = a_end - a_start == b_end - b_start
    at = np.flatnonzero(same)
    n = a_end[at] - a_start[at]
    differ = a[ranges(a_start[at], n)] != b[ranges(b_start[at], n)]
    same[np.repeat(at, n)[differ]] = False
    return same


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the first `depth` words or more from each (0 sorts first and ends a run)."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and len(seq):
        after = np.zeros(len(seq), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(seq) + 2) + after
        found, rank = np.unique(key, return_inverse=True)
        if len(found) == len(seq):
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def refine(column, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Vectorised bisection of word in column(position) within each [lo, hi)."""
    lo, hi = lo.copy(), hi.copy()
    while len(go := np.flatnonzero(lo < hi)):
        mid = (lo[go] + hi[go]) >> 1
        x = column(mid)
        up = (x <= word[go]) if right else (x < word[go])
        lo[go[up]] = mid[up] + 1
        hi[go[~up]] = mid[~up]
    return lo


def search(b: Suffixes, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows: suffix, first word, words of the window."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(b.start) or not len(ids):
        return none
    known = ids > 0
    brk = np.ones(len(ids), bool)
    brk[1:] = (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
    run = np.cumsum(brk) - 1
    length = np.bincount(run)
    keep = np.flatnonzero(known & (length[run] >= b.need.min()))
    if not len(keep):
        return none
    gap = np.flatnonzero(brk[keep])
    at = np.insert(keep, gap, -1)  # a 0 before each run
    seq = np.concatenate([np.where(at < 0, 0, ids[at]), [0]])
    at = np.append(at, -1)
    depth = int(b.need.max())
    order = suffix_array(seq, depth)
    lo = np.zeros(len(b.start), np.int64)
    hi = np.full(len(b.start), len(order), np.int64)
    at_need: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(len(b.start))
    for k in range(depth):
        live = live[b.need[live] > k]
        if not len(live):
            break
        word = b.seq[b.start[live] + k]
        column = lambda i, k=k: seq[np.minimum(order[i] + k, len(seq) - 1)]
        left = refine(column, lo[live], hi[live], word, False)
        right = refine(column, left, hi[live], word, True)
        some = left < right
        live, left, right = live[some], left[some], right[some]
        lo[live], hi[live] = left, right
        done = b.need[live] == k + 1
        at_need.append((live[done], left[done], right[done]))
    hit, left, right = (np.concatenate(x) for x in zip(*at_need)) if at_need else none
    return np.repeat(hit, right - left), at[order[ranges(left, right - left)]], np.repeat(b.need[hit], right - left)


def word_ids(b: Suffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of each word in the vocabulary (0: none), its row, the lower-cased bytes, and starts and ends of words."""
    low, starts, ends, row = words(data, offsets)
    h = word_hashes(low, starts, ends)
    if not len(b.vocabulary):
        return np.zeros(len(h), np.int64), row, low, starts, ends
    at = np.minimum(np.searchsorted(b.vocabulary, h), len(b.vocabulary) - 1)
    return np.where(b.vocabulary[at] == h, at + 1, 0), row, low, starts, ends


@dataclass
class Found:
    """Occurrences of windows in a slab: suffix, row, first word in its row, words of the window and of the longest match."""

    suffix: np.ndarray
    row: np.ndarray
    first: np.ndarray
    need: np.ndarray
    longest: np.ndarray
    n_words: np.ndarray


def find(b: Suffixes, data: np.ndarray, offsets: np.ndarray) -> Found:
    ids, row, low, starts, ends = word_ids(b, data, offsets)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    suffix, at, _ = search(b, ids, row)
    if len(at):  # occurrences by hash; look at the bytes of their words
        inside = np.unique(ranges(at, b.need[suffix]))
        v = ids[inside] - 1
        false = np.zeros(len(ids) + 1, np.int64)
        false[inside[~same_words(low, starts[inside], ends[inside], b.spelling, b.spelt[v], b.spelt[v + 1])] + 1] = 1
        false = np.cumsum(false)
        true = false[at + b.need[suffix]] == false[at]
        suffix, at = suffix[true], at[true]
    longest = b.need[suffix].copy()
    last = np.cumsum(n_words)
    live = np.arange(len(at))
    while len(live):  # follow each occurrence to the end of its match
        k, s, f = longest[live], suffix[live], at[live]
        live = live[(k < b.room[s]) & (f + k < last[row[f]])]
        k, s, f = longest[live], suffix[live], at[live]
        live = live[b.seq[b.start[s] + k] == ids[f + k]]
        longest[live] += 1
    base = last - n_words
    rows = row[at] if len(at) else at
    return Found(suffix, rows, at - base[rows] if len(at) else at, b.need[suffix], longest, n_words)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of about block_bytes; a block's bytes are bounded, whatever their number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t")).where("k is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == k)
        yield [(r.k, r.t) for r in part.collect()]


_FOUND = "n_words bigint, spans array<bigint>, items array<string>, longest struct<words:bigint,first:bigint,item:string>"
_LONGEST = pa.struct([("words", pa.int64()), ("first", pa.int64()), ("item", pa.string())])


def finder(spark: SparkSession, block: list[tuple[str, str]], window: int):
    """A column function: text to words, spans of windows (start, end, start, ...), their items, and the longest match."""
    shipped = spark.sparkContext.broadcast(benchmark_suffixes(block, window))

    @F.arrow_udf(_FOUND)
    def found(text: pa.Array) -> pa.Array:
        b = shipped.value
        n_words, spans, items, longest = [np.zeros(0, np.int64)], [], [], []
        for part, data, offsets in slabs(pa.RecordBatch.from_arrays([text], names=["text"])):
            f = find(b, data, offsets)
            n_words.append(f.n_words)
            own_spans, own_items, own_longest = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)], [None] * part.num_rows
            order = np.lexsort((f.first, f.row))
            for mine in np.split(order, np.flatnonzero(np.diff(f.row[order])) + 1) if len(order) else []:
                r = f.row[mine[0]]
                own_spans[r] = np.stack([f.first[mine], f.first[mine] + f.need[mine]], 1).ravel().tolist()
                own_items[r] = sorted({b.names[i] for i in np.unique(b.item[f.suffix[mine]])})
                top = mine[f.longest[mine] == f.longest[mine].max()]
                first, item = min((int(f.first[k]), b.names[b.item[f.suffix[k]]]) for k in top)
                own_longest[r] = {"words": int(f.longest[top[0]]), "first": first, "item": item}
            spans += own_spans
            items += own_items
            longest += own_longest
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_words)), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest, _LONGEST)],
            names=["n_words", "spans", "items", "longest"],
        )

    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id with n_words, n_hit, n_items, items, contaminated, and the longest match: longest_words, longest_at (its first word), longest_item."""
    each = [finder(docs.sparkSession, block, window)("text") for block in _blocks(benchmark, block_bytes)]
    inner = docs.select("doc_id", F.array(*each).alias("found"))

    @F.arrow_udf("bigint")
    def covered(spans: pa.Array) -> pa.Array:
        return pa.array([_covered(np.asarray(x, np.int64)) for x in spans.to_pylist()], pa.int64())

    def later(a, b):
        """The longer of two matches, or the one that comes first."""
        return F.when(b.isNull() | (a["words"] > b["words"]) | ((a["words"] == b["words"]) & (F.struct(a["first"], a["item"]) <= F.struct(b["first"], b["item"]))), a).otherwise(b)

    none = F.lit(None).cast("struct<words:bigint,first:bigint,item:string>")
    flat = inner.select(
        "doc_id",
        F.col("found")[0]["n_words"].alias("n_words"),
        F.flatten("found.spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("found.items"))).alias("items"),
        F.aggregate("found.longest", none, lambda a, b: F.when(a.isNull(), b).otherwise(later(a, b))).alias("longest"),
    )
    n_hit = F.when(F.size("spans") > 0, covered("spans")).otherwise(F.lit(0).cast("bigint"))
    return flat.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"),
        F.coalesce("longest.words", F.lit(0)).cast("bigint").alias("longest_words"), F.col("longest.first").alias("longest_at"), F.col("longest.item").alias("longest_item"),
    )


def _covered(spans: np.ndarray) -> int:
    """Words in any of the spans (start, end, start, end, ...)."""
    if not len(spans):
        return 0
    start, end = spans[::2], spans[1::2]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    return int(np.maximum(0, end - np.maximum(start, np.concatenate([[0], end[:-1]]))).sum())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with their columns, that hold no benchmark window."""
    for block in _blocks(benchmark, block_bytes):
        docs = docs.where(F.size(finder(docs.sparkSession, block, window)("text")["items"]) == 0)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_words", "longest_at", "longest_item")


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


# A match is a run of windows on one diagonal of an item's and a document's words.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT q, item_id, i AS j, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM
       (SELECT q, item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(CASE WHEN len(w) >= {WINDOW} THEN len(w) - {WINDOW} + 1 WHEN len(w) > 0 THEN 1 ELSE 0 END)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM
       (SELECT r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, lens)),
hit AS (SELECT r, i, dw.n, q, item_id, j FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, array_to_string(list_sort(list(k)), ',') AS s FROM (SELECT DISTINCT r, item_id AS k FROM hit) GROUP BY r),
runs AS (SELECT r, item_id, min(i) AS first, count(*) + any_value(n) - 1 AS words FROM
         (SELECT *, i - row_number() OVER (PARTITION BY r, q, i - j ORDER BY i) AS run FROM hit) GROUP BY r, q, item_id, i - j, run),
top AS (SELECT r, words, first, item_id FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY words DESC, first, item_id) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(words, 0) AS BIGINT) AS longest_words, CAST(first AS BIGINT) AS longest_at, top.item_id AS longest_item
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN top USING (r)"""
