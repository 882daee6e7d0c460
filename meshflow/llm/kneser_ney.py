"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

For each language a byte n-gram model of order ORDER is estimated from all trusted documents but one in
HOLD_OUT, which set the thresholds (A-Z lower-cased, with start and end symbols). Everything is one plan:

1. Documents are dealt into blocks of bounded bytes, the one exchange of texts, compressed. A block sends each
   distinct n-gram of its documents, with its count in trusted ones, to the shard of its language and the
   two bytes before its last, which all of its suffixes from three bytes on share.
2. Shards merge counts, first over PART_BLOCKS blocks each, then over all. From these come the counts of
   counts and the continuation counts of pairs of bytes, by which each language's discounts and its
   distributions after one byte are computed.
3. Shards join the blocks' n-grams with their counts: continuation counts, discounts, interpolation
   weights and probabilities of the orders from three on are those of n-grams that share the shard.
4. Blocks join the probabilities of their n-grams (rounded by at most GRAIN / 2 in their logarithm) with their
   documents and add up.

Nothing passes through the driver and nothing is broadcast. A frequent pair of bytes is spread by the byte
before it over SPREAD_BYTES shards, and the blocks of a shard are dealt into parts, each with the shard's
counts, so that no task's share grows with the number of blocks.

A document is kept if its perplexity per byte is no more than the QUANTILE among trusted documents of its
language that the model hasn't seen: one in HOLD_OUT of them, by the hash of the id, is not trained on (a
language with none of these takes the quantile of those trained on). Quantiles are exact to the histogram's
step of STEP in log perplexity.

Defined results: null and empty texts have no perplexity and are not kept. A null language is a language
of its own; a document whose language has no trusted text has no perplexity and is not kept. Ties with
the threshold are kept. Repeated rows count each; a null id is never trusted. A very long text is a slab
of its own. Empty tables: empty result, or nothing is kept. Columns other than doc_id, text and lang, and
the labels' doc_id and quality, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import settle, spread_join
from .slabs import _LOWER, slabs

#: An order of up to 6 fits into the words that are sorted.
ORDER, QUANTILE, STEP, HOLD_OUT = 6, 0.95, 0.0005, 5
START, END, SYMBOLS = 255, 254, 257
#: Text bytes of a block and, on average, of a shard; blocks of a part; shards over which a pair of bytes is spread.
BLOCK_BYTES, SHARD_BYTES, PART_BLOCKS, SPREAD_BYTES = 16 << 20, 64 << 20, 1024, 16
#: Log probabilities are sent back in steps of this, from 0 to -32.
GRAIN = 1 / 2048
_SLAB, _ROWS = 1 << 19, 20_000
_COUNTS, _DEFAULT = -2, -1


def grams(data: np.ndarray, offsets: np.ndarray, n: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n bytes that end at each byte or end mark of each row, and the row."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    wide = offsets[:-1] + np.arange(rows) * n
    out = np.full(len(data) + rows * n, START, np.int64)
    at = np.arange(len(data)) + np.repeat((np.arange(rows) + 1) * n - 1, size)
    out[at] = _LOWER[data]
    ends = wide + n - 1 + size
    out[ends] = END
    code = np.zeros(len(out), np.int64)
    for k in range(n):
        code[k:] |= out[: len(out) - k] << (8 * k)
    keep = np.ones(len(out), bool)
    for k in range(n - 1):
        keep[wide + k] = False
    keep[ends[size == 0]] = False  # nothing to score in an empty text
    row = np.repeat(np.arange(rows), size + n)
    return code[keep], row[keep]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more, from the numbers of n-grams with count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1), min(max(d2, 0.05), 2), min(max(d3, 0.05), 3)


def pack(key: np.ndarray, value: np.ndarray) -> bytes:
    """Sorted 64-bit keys and a value of each, byte by byte, as equal bytes then stand together."""
    n = len(key)
    planes = [np.diff(key, prepend=0).astype("<i8").view(np.uint8).reshape(n, 8).T, value.view(np.uint8).reshape(n, value.itemsize).T]
    raw = b"".join(np.ascontiguousarray(p).tobytes() for p in planes)
    return n.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes, dtype) -> tuple[np.ndarray, np.ndarray]:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(packed[8:], (8 + width) * n, "zstd", asbytes=True), np.uint8)
    key = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(key), np.ascontiguousarray(raw[8 * n :].reshape(width, n).T).view(dtype).ravel()


def merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if len(pairs) == 1:
        return pairs[0]
    keys, counts = (np.concatenate(x) for x in zip(*pairs, strict=True))
    key, back = np.unique(keys, return_inverse=True)
    return key, np.bincount(back, counts, minlength=len(key)).astype(np.int64)


def shard_of(lang: str, key: np.ndarray, shards: int) -> np.ndarray:
    home = np.array([zlib.crc32(f"{b}|{lang}".encode()) % shards for b in range(256)])
    return (home[key >> 8 & 255] + (key >> 16 & 255) * 7 % min(SPREAD_BYTES, shards)) % shards


def continued(key: np.ndarray, count: np.ndarray, order: int, least: int = 3) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, k-grams in order, count): counts of the highest order, continuation counts of the others down to `least`."""
    for k in range(order, least - 1, -1):
        if k < order:
            key, count = np.unique(key & ((1 << 8 * k) - 1), return_counts=True)
        yield k, key, count


def _cut(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3).astype(np.int64) - 1]


def low_orders(kind: np.ndarray, key: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Of one language: discounts of the orders from 3 on, distribution after an unseen byte, and after each byte seen.

    Kind 2: a pair of bytes and its continuation count; kind k from 3 on: a count of 1 to 4 and the k-grams that have it.
    """
    d = np.zeros((order + 1, 3))
    for k in range(3, order + 1):
        of = [0] * 4
        for c, m in zip(key[kind == k].tolist(), n[kind == k].tolist(), strict=True):
            of[c - 1] = m
        d[k] = discounts(of)
    pair, c2 = key[kind == 2], n[kind == 2]
    single, c1 = np.unique(pair & 255, return_counts=True)
    d1, d2 = (np.array(discounts([int((c == j).sum()) for j in (1, 2, 3, 4)])) for c in (c1, c2))
    one = np.full(256, _cut(d1, c1).sum() / c1.sum() / SYMBOLS)
    one[single] += (c1 - _cut(d1, c1)) / c1.sum()
    two = {}
    for b in np.unique(pair >> 8).tolist():
        own = pair >> 8 == b
        c = c2[own]
        p = _cut(d2, c).sum() / c.sum() * one
        p[pair[own] & 255] += (c - _cut(d2, c)) / c.sum()
        two[b] = p
    return d, one, two


def probabilities(asked: np.ndarray, key: np.ndarray, count: np.ndarray, order: int, d: np.ndarray, one: np.ndarray, two: dict[int, np.ndarray]) -> np.ndarray:
    """Of the asked n-grams' last bytes; key and count are all counted n-grams with the same bytes before the last."""
    table = np.tile(one, (256, 1))
    for b, p in two.items():
        table[b] = p
    p = table[asked >> 8 & 255, asked & 255]
    for k, t, c in reversed(list(continued(key, count, order))):
        if not len(t):
            continue
        g = asked & ((1 << 8 * k) - 1)
        cut = _cut(d[k], c)
        first = np.flatnonzero(np.concatenate([[True], t[1:] >> 8 != t[:-1] >> 8]))
        context, total, rest = t[first] >> 8, np.add.reduceat(c, first), np.add.reduceat(cut, first)
        at = np.minimum(np.searchsorted(context, g >> 8), len(context) - 1)
        seen = context[at] == g >> 8
        to = np.minimum(np.searchsorted(t, g), len(t) - 1)
        own = np.where(t[to] == g, c[to] - cut[to], 0)
        p = np.where(seen, (own + rest[at] * p) / total[at], p)
    return p


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """doc_id, lang, n (scored symbols) and log_p of each row; log_p is null where there is nothing to score.

    trusted: the doc_ids whose texts are counted.
    """
    spark = docs.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // shard_bytes))
    parts = -(-blocks // part_blocks)
    id_type, id_arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    # null ids are never trusted, and may be dealt by text
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int").alias("block")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a batch that go to one block, compressed together."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            rows, number = pa.Table.from_batches([batch]).drop_columns(["block"]).take(order).combine_chunks(), number[order]
            cuts = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(number))
            payloads = []
            for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                    writer.write_table(rows.slice(at, end - at))
                payloads.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(number[cuts[:-1]], pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])

    held = docs.select(block, "doc_id", "text", "lang").mapInArrow(packed, "block int, payload binary").repartition(max(session, blocks), "block")
    known = trusted.where("doc_id is not null").select("doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def parts_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str], np.ndarray]]:
        """Slabs of a block's documents with its languages (as =name, or empty for null) and each row's number among them."""
        for payload in table.column("payload"):
            for batch in pa.ipc.open_stream(payload.as_buffer()):
                for at in range(0, batch.num_rows, _ROWS):
                    for part, data, offsets in slabs(batch.slice(at, _ROWS), limit=_SLAB):
                        lang = pc.dictionary_encode(part.column(part.schema.get_field_index("lang")), null_encoding="encode")
                        names = ["" if x is None else f"={x}" for x in lang.dictionary.to_pylist()]
                        yield part, data, offsets, names, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    asked_schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("own", pa.string()), ("payload", pa.binary())])

    def ask(table: pa.Table, ids: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for part, data, offsets, langs, lang in parts_of(table):
            code, row = grams(data, offsets, order)
            counted = pc.is_in(part.column(part.schema.get_field_index("doc_id")), value_set=ids.column("doc_id").combine_chunks(), skip_nulls=True)
            counted = counted.to_numpy(zero_copy_only=False).astype(np.uint64)
            word = np.sort(lang[row].astype(np.uint64) << np.uint64(49) | code.astype(np.uint64) << np.uint64(1) | counted[row])
            key = word >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat((word & np.uint64(1)).astype(np.int64), first) if len(key) else first
            key = key[first].astype(np.int64)
            cuts = np.searchsorted(key, np.arange(len(langs) + 1) << 48)
            for name, a, b in zip(langs, cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    held = found.setdefault(name, [])
                    held.append((key[a:b] & ((1 << 48) - 1), n[a:b]))
                    if len(held) > 8:
                        found[name] = [merged(held)]
        out = {c: [] for c in asked_schema.names}
        for name, pairs in found.items():
            key, n = merged(pairs)
            shard = shard_of(name, key, shards)
            by = np.argsort(shard, kind="stable")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(shard[by]) > 0])), len(by))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                number = table.column("block")[0].as_py()
                for c, x in zip(out, (int(shard[by[a]]), number % parts, number, name, pack(key[by[a:b]], n[by[a:b]].astype(np.int32))), strict=True):
                    out[c].append(x)
        return pa.table(out, asked_schema)

    asked = held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(ask, "shard int, part int, block int, own string, payload binary")
    asked = asked.repartition(max(session, shards * parts), "shard", "part")

    def merge(table: pa.Table) -> pa.Table:
        """One row for each language of a shard with what is counted in trusted text; counts are 64-bit as two of the 32-bit values."""
        sums: dict[str, list] = {}
        for name, packed in zip(table.column("own").to_pylist(), table.column("payload").to_pylist(), strict=True):
            key, n = unpack(packed, np.int32) if "block" in table.column_names else _wide(packed)
            held = sums.setdefault(name, [])
            held.append((key[n > 0], n[n > 0].astype(np.int64)))
            if len(held) > 8:
                sums[name] = [merged(held)]
        sums = {name: x for name, pairs in sums.items() if len((x := merged(pairs))[0])}
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(sums), pa.int32()), "own": pa.array(sums, pa.string()), "payload": pa.array([_narrow(*x) for x in sums.values()], pa.binary())})

    merged_schema = "shard int, own string, payload binary"
    partly = asked.groupBy("shard", "part").applyInArrow(merge, merged_schema)
    counts = partly.repartition(max(session, shards), "shard").groupBy("shard").applyInArrow(merge, merged_schema)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds, keys, ns = [], [], []
                for k, t, c in continued(*_wide(packed), order):
                    of = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5]
                    kinds.append(np.full(4, k))
                    keys.append(np.arange(1, 5))
                    ns.append(of)
                pair, c2 = np.unique(t & 0xFFFF, return_counts=True)  # a shard has all 3-grams with these two bytes before the last
                kind = np.concatenate([*kinds, np.full(len(pair), 2)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kind), pa.string()), pa.array(kind, pa.int32()), pa.array(np.concatenate([*keys, pair]), pa.int64()), pa.array(np.concatenate([*ns, c2]), pa.int64())], names=["own", "kind", "key", "n"])

    sums = counts.select("own", "payload").mapInArrow(statistics, "own string, kind int, key bigint, n bigint").groupBy("own", "kind", "key").agg(F.sum("n").alias("n"))

    def low(table: pa.Table) -> pa.Table:
        """Rows (own, byte, payload): discounts and distribution after an unseen byte (_DEFAULT), and after each byte seen."""
        name = table.column("own")[0].as_py()
        d, one, two = low_orders(*(table.column(c).to_numpy() for c in ("kind", "key", "n")), order)
        rows = [(_DEFAULT, d.tobytes() + one.tobytes()), *((b, p.tobytes()) for b, p in two.items())]
        home = [zlib.crc32(f"{b}|{name}".encode()) % shards for b, _ in rows]
        return pa.table({"own": [name] * len(rows), "byte": pa.array([b for b, _ in rows], pa.int32()), "home": pa.array(home, pa.int32()), "payload": pa.array([x for _, x in rows], pa.binary())})

    low_rows = sums.groupBy("own").applyInArrow(low, "own string, byte int, home int, payload binary")
    spread = F.when(F.col("byte") == _DEFAULT, F.lit(shards)).otherwise(F.lit(min(SPREAD_BYTES, shards)))
    low_rows = low_rows.withColumn("sub", F.explode(F.sequence(F.lit(0), spread - 1))).select(F.pmod(F.col("home") + F.col("sub"), F.lit(shards)).cast("int").alias("shard"), "own", "byte", "payload")
    side = counts.select("shard", "own", F.lit(_COUNTS).alias("byte"), "payload").unionAll(low_rows).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    answer_schema = pa.schema([("block", pa.int32()), ("own", pa.string()), ("payload", pa.binary())])

    def answer(table: pa.Table, model: pa.Table) -> pa.Table:
        held: dict[str, dict] = {}
        for name, byte, payload in zip(*(model.column(c).to_pylist() for c in ("own", "byte", "payload")), strict=True):
            held.setdefault(name, {})[byte] = payload
        out = {c: [] for c in answer_schema.names}
        names, numbers, payloads = (table.column(c).to_pylist() for c in ("own", "block", "payload"))
        for name in dict.fromkeys(names):
            of = held.get(name)
            if not of or _DEFAULT not in of:
                continue  # no trusted text
            both = np.frombuffer(of[_DEFAULT], np.float64)
            d, one = both[:-256].reshape(order + 1, 3), both[-256:]
            two = {b: np.frombuffer(x, np.float64) for b, x in of.items() if b >= 0}
            key, count = _wide(of[_COUNTS]) if _COUNTS in of else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            mine = [i for i, x in enumerate(names) if x == name]
            for at in range(0, len(mine), 64):
                some = mine[at : at + 64]
                asks = [unpack(payloads[i], np.int32)[0] for i in some]
                whole = np.unique(np.concatenate(asks))
                log_p = np.log(probabilities(whole, key, count, order, d, one, two))
                log_p = np.minimum(np.round(-log_p / GRAIN), 65535).astype(np.uint16)
                for i, ask in zip(some, asks, strict=True):
                    for c, x in zip(out, (numbers[i], name, pack(ask, log_p[np.searchsorted(whole, ask)])), strict=True):
                        out[c].append(x)
        return pa.table(out, answer_schema)

    answers = asked.groupBy("shard", "part").cogroup(side.groupBy("shard", "part")).applyInArrow(answer, "block int, own string, payload binary")

    def add_up(table: pa.Table, answered: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for name, packed in zip(answered.column("own").to_pylist(), answered.column("payload").to_pylist(), strict=True):
            found.setdefault(name, []).append(unpack(packed, np.uint16))
        known = {}
        for name, pairs in found.items():
            key, value = (np.concatenate(x) for x in zip(*pairs, strict=True))
            by = np.argsort(key)
            known[name] = key[by], value[by] * -GRAIN
        none = np.zeros(0, np.int64), np.zeros(0)
        out = []
        for part, data, offsets, langs, lang in parts_of(table):
            code, row = grams(data, offsets, order)
            pairs = [known.get(name, none) for name in langs]
            keys = np.concatenate([none[0], *(key | k << 48 for k, (key, _) in enumerate(pairs))])
            values = np.concatenate([none[1], *(value for _, value in pairs)])
            scored = np.array([name in known for name in langs], bool)[lang] if langs else np.zeros(part.num_rows, bool)
            code, row = code[scored[row]], row[scored[row]]
            n = np.bincount(row, minlength=part.num_rows)
            total = np.bincount(row, values[np.searchsorted(keys, lang[row] << 48 | code)], minlength=part.num_rows)
            columns = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang")]
            out.append(pa.table([*columns, pa.array(n, pa.int64()), pa.array(total.astype(float), mask=n == 0)], names=["doc_id", "lang", "n", "log_p"]))
        if not out:  # trusted ids without documents
            return pa.table({"doc_id": pa.array([], id_arrow), "lang": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "log_p": pa.array([], pa.float64())})
        return pa.concat_tables(out)

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {id_type}, lang string, n bigint, log_p double")


def _narrow(key: np.ndarray, n: np.ndarray) -> bytes:
    """Keys with 64-bit counts."""
    low, high = pack(key, (n & 0xFFFFFFFF).astype(np.uint32)), pack(key[n >> 32 > 0], (n[n >> 32 > 0] >> 32).astype(np.uint32))
    return len(low).to_bytes(8, "little") + low + high


def _wide(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = 8 + int.from_bytes(packed[:8], "little")
    (key, low), (more, high) = unpack(packed[8:size], np.uint32), unpack(packed[size:], np.uint32)
    n = low.astype(np.int64)
    n[np.searchsorted(key, more)] += high.astype(np.int64) << 32
    return key, n


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, **sizes) -> DataFrame:
    """doc_id, lang, perplexity, threshold and keep of each row; trusted are the documents labelled with quality 1."""
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0
    scored = perplexities(docs, trusted.where(~unseen), order, **sizes)
    own = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("own")
    scored = settle(scored.select("doc_id", "lang", own, (-F.col("log_p") / F.col("n")).alias("loss")))
    held = scored.where("loss is not null").join(trusted, "doc_id", "left_semi").groupBy("own", unseen.alias("unseen"), F.ceil(F.col("loss") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("own", "unseen")
    held = held.withColumn("sum", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    limit = held.where(F.col("sum") >= F.lit(quantile) * F.col("all")).groupBy("own", "unseen").agg((F.min("bin") * STEP).alias("most"))
    limit = settle(limit.groupBy("own").agg(F.max_by("most", "unseen").alias("most")))
    # every language with a trusted document that can be scored has a limit, and each language without has no loss
    found = spread_join(scored.where("loss is not null"), limit, ["own"], scored.count())
    none = scored.where("loss is null").withColumn("most", F.lit(None).cast("double"))
    rows = found.select("doc_id", "lang", "loss", "most").unionAll(none.select("doc_id", "lang", "loss", "most"))
    return rows.select("doc_id", "lang", F.exp("loss").alias("perplexity"), F.exp("most").alias("threshold"), F.coalesce(F.col("loss") <= F.col("most"), F.lit(False)).alias("keep"))


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
