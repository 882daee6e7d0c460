"""Near-duplicates by weighted MinHash of bags of word shingles, verified exactly.

A document is a bag of SHINGLE-word shingles (one shingle of all its words, if it has fewer). Each
shingle drives Poisson processes over its weight axis, cut at 1, 2, 4, 8, ...: a process for each
such block that the multiplicity reaches into, its points spread over the block's cells by the bits of
their hashes, so that a multiplicity inside a block keeps just the points below it. A point carries a
register; the earliest point of each register is the signature, and two bags agree in a register with
the probability of their weighted Jaccard similarity. Points are generated in time order up to a bound
by which a bag of this weight has very likely filled its registers, and further for those that have not.

Signatures are cut into bands. Documents with equal bags are one vertex. In each bucket of a band every
member is paired with the one that meets most others in all buckets, its centre, and pairs are verified
on the whole texts by the exact similarity of the bags (shingles being compared by 64-bit hashes).
Buckets whose members are then still in several components pair members across components inside blocks
of bounded bytes, where their signatures agree well enough not to be excluded; a pair is looked at in
the first band that it shares. Connected components of the verified links are the classes.

With 24 bands of 5 rows, a pair of similarity 0.8 shares no bucket with probability 7e-5, and less when
it is more alike; it is excluded by its signatures with probability 2e-7.

Buckets, centres, labels and bags that very many rows share are never dealt to one task: their rows stay
where they are and look the key up (shared.spread_join), and a centre with very many members is sent to
several tasks, each with a part of them. Tasks stream texts sorted by centre, of which they hold one slab.

Defined results: null and empty texts, and texts without words, are classes of their own. Rows with the
same id are one document when classes are formed; rows with a null id have no class (null) and stay.
Repeated rows and ties don't matter. Very long texts are compared whole; a slab then holds that text
alone. Empty table: empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import few_rows_at_once, heavy_from, settle, settle_rows, spread_join
from .slabs import hashed_words, mix, ranges, slabs, trim

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Registers that must agree for a pair in a mixed bucket to be verified; a pair of similarity 0.8 agrees
#: in 96 of 120 on average and in fewer than 72 with probability 2e-7.
LEAST_AGREEING = 72
#: Members of a block of a mixed bucket, and bytes of their bags.
BLOCK_MEMBERS, BLOCK_BYTES = 1000, 6 << 20
_SLAB = 1 << 19
_M = BANDS * ROWS
_AT_ONCE = 1 << 19


def bags(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, multiplicity), ordered by row and hash."""
    h, row = hashed_words(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    many = np.maximum(n - size + 1, np.minimum(n, 1))
    at = ranges(first, many)
    of = np.repeat(np.arange(rows), many)
    width = np.minimum(n[of], size)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = width > k
        out[inside] = mix(out[inside] + h[at[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((out, of))
    of, out = of[order], out[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (out[1:] != out[:-1])
    cut = np.flatnonzero(fresh)
    return of[cut], out[cut], np.diff(np.append(cut, len(of)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, m: int = _M) -> np.ndarray:
    """rows x m hashes of the earliest points; rows without shingles are all 0."""
    best = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint64)
    if not len(row):
        return sig.reshape(rows, m)
    # a node for each block [0,1), [1,2), [2,4), ... of the weight axis that the multiplicity reaches into
    blocks = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(row)), blocks)
    level = ranges(np.zeros(len(blocks), np.int64), blocks)
    lower = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    cells = np.maximum(1, lower)  # a block's length is its rate
    seed = mix(shingle[at] + mix((level + 1).astype(np.uint64)))
    of, keep_below, time = row[at], weight[at] - lower, np.zeros(len(at))
    total = np.bincount(row, weight, minlength=rows)
    bound = m * (np.log(m) + 3) / np.maximum(total, 1)
    waiting, turn = np.zeros(0, np.int64), np.uint64(0)
    turns = np.zeros(len(at), np.uint64)
    live = np.arange(len(at))
    pending = _next_point(seed, turns, cells)
    time = time + pending
    while True:
        soon = time[live] <= bound[of[live]]
        waiting = np.concatenate([waiting, live[~soon]])
        live = live[soon]
        if not len(live):
            empty = ~np.isfinite(best.reshape(rows, m)).all(1) & (total > 0)
            if not empty.any():
                return sig.reshape(rows, m)
            bound[empty] *= 2
            again = empty[of[waiting]]
            live, waiting = waiting[again], waiting[~again]
            continue
        point = mix(seed[live] ^ mix(turns[live] * np.uint64(2) + np.uint64(1)))
        cell = (mix(point + np.uint64(7)) % cells[live].astype(np.uint64)).astype(np.int64)
        inside = cell < keep_below[live]
        slot = of[live] * m + (mix(point + np.uint64(13)) % np.uint64(m)).astype(np.int64)
        slot, t, value = slot[inside], time[live][inside], point[inside]
        order = np.lexsort((t, slot))
        slot, t, value = slot[order], t[order], value[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, t, value = slot[first], t[first], value[first]
        earlier = t < best[slot]
        best[slot[earlier]], sig[slot[earlier]] = t[earlier], value[earlier]
        turns[live] += np.uint64(1)
        time[live] += _next_point(seed[live], turns[live], cells[live])


def _next_point(seed: np.ndarray, turn: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return -np.log(_uniform(mix(seed + mix(turn * np.uint64(2))))) / rate


def sign(texts: DataFrame) -> DataFrame:
    """doc_id, tx, bag_a, bag_b (a 128-bit hash of the bag; null without words), weight, bands, registers of (doc_id, tx, text)."""
    key = texts.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slabs(batch, limit=_SLAB):
                row, shingle, weight = bags(data, offsets)
                n = part.num_rows
                has = np.bincount(row, minlength=n) > 0
                sig = signatures(row, shingle, weight, n)
                whole = []
                for salt in (1, 2):
                    x = mix(shingle + np.uint64(salt)) * mix(weight.astype(np.uint64) + np.uint64(salt))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    at = np.searchsorted(row, np.arange(n + 1))
                    whole.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64), mask=~has))
                h = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    h = mix(h + sig[:, k::ROWS] + np.uint64(k + 1))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(h.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                registers = [x.tobytes() for x in sig.astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *whole, pa.array(np.bincount(row, weight, minlength=n).astype(np.int64)), bands, pa.array(registers, pa.binary())], names=["doc_id", "tx", "bag_a", "bag_b", "weight", "bands", "registers"])

    return texts.select("doc_id", "tx", "text").mapInArrow(signed, f"doc_id {key}, tx bigint, bag_a bigint, bag_b bigint, weight bigint, bands array<bigint>, registers binary")


def overlap(h: np.ndarray, w: np.ndarray, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """What each row's bag has in common with the bag (h, w), h being sorted."""
    place = np.minimum(np.searchsorted(h, shingle), len(h) - 1)
    both = np.where(h[place] == shingle, np.minimum(w[place], weight), 0)
    return np.bincount(row, both, minlength=rows)


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of those pairs (id, tx, cid, ctx) whose bags are at least so alike.

    Each task streams centres (cid, ctx) with their members: only the centre's bag is held.
    """
    most = heavy_from(pairs.count())
    parts = pairs.groupBy("cid", "ctx").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cid", "ctx", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(parts), ["cid", "ctx"], "left").withColumn("part", F.pmod(F.xxhash64("id", "tx"), F.coalesce("parts", F.lit(1))).cast("int"))
    member = dealt.select("id", "tx", "cid", "ctx", "part", F.lit(1).alias("turn"))
    centre = dealt.select(F.col("cid").alias("id"), F.col("ctx").alias("tx"), "cid", "ctx", "part", F.lit(0).alias("turn")).distinct()
    once = texts.groupBy(F.col("doc_id").alias("id"), "tx").agg(F.first("text").alias("text"))
    met = member.unionAll(centre).join(once, ["id", "tx"]).repartition("cid", "ctx", "part").sortWithinPartitions("cid", "ctx", "part", "turn")
    key = texts.schema["doc_id"].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part, data, offsets in slabs(batch, limit=_SLAB):
                row, shingle, weight = bags(data, offsets)
                n = part.num_rows
                turn = part.column(2).to_numpy()
                total = np.bincount(row, weight, minlength=n)
                at = np.searchsorted(row, np.arange(n + 1))
                alike = np.zeros(n, bool)
                heads = np.flatnonzero(turn == 0).tolist()
                for i, j in zip([-1, *heads], [*heads, n], strict=True):  # members of the centre of the slab before come first
                    if i >= 0:
                        h, w = shingle[at[i] : at[i + 1]].copy(), weight[at[i] : at[i + 1]].copy()
                    if j > i + 1 and len(h):
                        own = slice(at[i + 1], at[j])
                        common = overlap(h, w, row[own] - i - 1, shingle[own], weight[own], j - i - 1)
                        alike[i + 1 : j] = common >= least * (total[i + 1 : j] + w.sum() - common)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["id", "cid"]).filter(pa.array(alike))

    links = met.select("id", "cid", "turn", "text").mapInArrow(compared, f"id {key}, cid {key}").where("id <> cid")
    return links.select(F.greatest("id", "cid").alias("a"), F.least("id", "cid").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id that is linked to it) of every id in links (a, b)."""
    both = settle_rows(links.select("a", "b").unionAll(links.select("b", "a").toDF("a", "b")).distinct())
    rows = both.count()
    label = settle_rows(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = spread_join(both, label.select(F.col("id").alias("b"), F.col("label").alias("l")), ["b"], rows).groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        new = settle_rows(label.join(near, "id").select("id", F.least("label", "l").alias("label"), F.col("label").alias("old")))
        up = new.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = settle_rows(spread_join(new, up, ["label"], rows).select("id", F.col("up").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def across_components(members: DataFrame, vertices: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members (band, h, n, w, id, tx, label) of one bucket with different labels.

    n and w are the bucket's members and their weight. They are dealt into blocks of bounded members and
    bytes, and each pair of blocks is one group. It holds the members' bags, so pairs are verified where
    they meet and none but links leave it.
    """
    key = texts.schema["doc_id"].dataType.simpleString()
    ids = members.select("id", "tx").distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slabs(batch, limit=_SLAB):
                row, h, w = bags(data, offsets)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                both = [h[i:j].tobytes() + w[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.binary())], names=["id", "tx", "bag"])

    asked = texts.select(F.col("doc_id").alias("id"), "tx", "text").join(ids, ["id", "tx"], "left_semi")
    bag = asked.mapInArrow(packed, f"id {key}, tx bigint, bag binary").groupBy("id", "tx").agg(F.first("bag").alias("bag"))
    whole = bag.join(vertices.select("id", "tx", "weight", "registers", "bands"), ["id", "tx"])
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("w") * 12 / BLOCK_BYTES)).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id", "tx"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "tx", "label").join(whole, ["id", "tx"])

    def compared(table: pa.Table) -> pa.Table:
        trim()
        ids, label, weight, own = (table.column(c).to_numpy() for c in ("id", "label", "weight", "own"))
        sig = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        raw = table.column("bag").to_pylist()
        size = np.array([len(x) // 12 for x in raw])
        first = np.cumsum(size) - size
        h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, size.tolist(), strict=True)])
        w = np.concatenate([np.frombuffer(x, np.int32, n, 8 * n) for x, n in zip(raw, size.tolist(), strict=True)])
        band = table.column("band")[0].as_py()
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        a, b = [ids[:0]], [ids[:0]]
        for k in range(len(ids)):
            near = np.flatnonzero((ids < ids[k]) & (label != label[k]) & (np.minimum(weight, weight[k]) >= SIMILARITY * np.maximum(weight, weight[k])) & ((own != own[k]) | (not across)))
            near = near[~(bands[near, :band] == bands[k, :band]).any(1)]  # met in an earlier band
            near = near[(sig[near] == sig[k]).sum(1) >= LEAST_AGREEING]
            done = 0
            while done < len(near):
                some = near[done : done + max(1, int(np.searchsorted(np.cumsum(size[near[done:]]), _AT_ONCE, "right")))]
                done += len(some)
                mine, at = slice(first[k], first[k] + size[k]), ranges(first[some], size[some])
                common = overlap(h[mine], w[mine], np.repeat(np.arange(len(some)), size[some]), h[at], w[at], len(some))
                some = some[common >= SIMILARITY * (weight[some] + weight[k] - common)]
                a.append(np.full(len(some), ids[k]))
                b.append(ids[some])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.groupBy("band", "h", "i", "j").applyInArrow(compared, f"a {key}, b {key}").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id (the smallest id of the class) of each row."""
    with few_rows_at_once(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.xxhash64("text").alias("tx"), "text")  # tx tells the texts of one id apart
    signed = settle(sign(texts))
    v = F.min(F.struct(F.col("doc_id").alias("id"), "tx")).alias("v")
    vertices = signed.where("bag_a is not null and doc_id is not null").groupBy("bag_a", "bag_b").agg(v, F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    vertices = settle_rows(vertices.select("bag_a", "bag_b", "v.id", "v.tx", "weight", "bands", "registers"), 20_000)
    rows = vertices.count() * BANDS
    bucket = ["band", "h"]
    members = vertices.select("id", "tx", "weight", F.posexplode("bands").alias(*bucket))
    sizes = settle_rows(members.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1"))
    heavy = sizes.where(F.col("n") > heavy_from(rows))
    in_buckets = settle_rows(spread_join(members, sizes, bucket, rows, heavy).select(*bucket, "n", "w", "id", "tx"))
    # the text that copies were made from meets more of them than they meet each other
    met = in_buckets.withColumn("met", F.sum("n").over(Window.partitionBy("id", "tx")))
    centres = met.groupBy(*bucket).agg(F.min(F.struct((-F.col("met")).alias("m"), "id", "tx")).alias("c"))
    centres = settle_rows(centres.select(*bucket, F.col("c.id").alias("cid"), F.col("c.tx").alias("ctx")))
    pairs = spread_join(in_buckets, centres, bucket, rows, heavy).where("id <> cid or tx <> ctx")
    links = settle_rows(verify(settle_rows(pairs.select("id", "tx", "cid", "ctx").distinct()), texts))
    label = components(links)
    # buckets whose members are not in one component yet
    labelled = settle_rows(in_buckets.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    mixed = labelled.groupBy(*bucket).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*bucket)
    left_over = settle_rows(spread_join(labelled, settle_rows(mixed), bucket, rows, heavy))
    if not left_over.isEmpty():
        label = components(links.unionAll(across_components(left_over, vertices, texts)))
    of_bag = settle_rows(vertices.select("bag_a", "bag_b", "id").join(label, "id", "left").select("bag_a", "bag_b", F.coalesce("label", "id").alias("class_id")))
    has = F.col("bag_a").isNotNull() & F.col("doc_id").isNotNull()
    named = spread_join(signed.where(has).select("doc_id", "bag_a", "bag_b"), of_bag, ["bag_a", "bag_b"], signed.count())
    return named.select("doc_id", "class_id").unionAll(signed.where(~has).select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, that are the smallest of their class; rows with a null id stay."""
    gone = near_duplicates(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns).unionAll(docs.where("doc_id is null"))


def op8_bag_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
