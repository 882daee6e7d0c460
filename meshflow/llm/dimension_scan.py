"""Approximate nearest neighbours by an adaptive scan over dimensions of the probed lists.

Vectors are normalised and rotated by one random orthogonal matrix. k-means centres, fitted on a
bounded sample of SAMPLE rows, split every row into lists; a query looks into its `probes` nearest
lists. In a list candidates are held in blocks of columns: after each block a hypothesis test compares
the partial distance, scaled to all dimensions, with the query's bound, and candidates that are farther with
high confidence are abandoned. The bound starts as the distance of the k-th best among SEEDS sampled rows and
falls as the scan of a list finds nearer rows. Those that stay are scored exactly by the cosine of the original
vectors in double precision.

A list is dealt out in chunks of rows, so that one frequent vector doesn't fill one task, and the
queries go to each chunk of their lists. Equal vectors are scanned once, whatever their number. Wherever
results are cut, k of each id and 2 k of all stay: without any one id, these hold the k best.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite
component take no part. Ties go to the smaller id. Fewer candidates than k: all of them. Repeated ids are
separate candidates, but a query's own id is never its result, whatever its rows; a query id with several
vectors has k results for each of them. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows on which centres are fitted, by the smallest hash of their ids.
SAMPLE = 20_000
#: Rows that a list holds on average, and the largest number of lists.
LIST_ROWS, MAX_LISTS = 500, 4096
#: Share of the lists that a query looks into, and the least number.
PROBE_SHARE, MIN_PROBES = 0.75, 8
#: Columns in a block, and how far a partial distance must exceed the bound, in standard deviations.
BLOCK, CONFIDENCE = 16, 2.1
CHUNK_ROWS = 2000
#: Rows of a chunk between which the bounds are tightened.
SLICE = 256
#: Sampled rows with which each query's first bound is found.
SEEDS = 2000


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows."""
    x = np.unique(x, axis=0)
    k = max(1, min(k, len(x)))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        n = np.bincount(near, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        full = (n > 0) & (size[:, 0] > 1e-12)
        c = np.where(full[:, None], new / np.maximum(size, 1e-12), c)
    return c.astype(np.float32)


def scan(queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test abandons. bound: of each query, the squared distance to be met.

    Rows are scanned SLICE at a time. The first block of columns is one matrix product; later blocks only look at
    the pairs that are left. After each slice a query's bound falls to the distance of the best k + 1 ids (ids: one
    of each row), of which one may be its own.
    """
    dim = rows.shape[1]
    bound = bound.astype(np.float32).copy()
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))  # query, id, distance

    def limit(end: int, of: np.ndarray) -> np.ndarray:
        scale = (end / dim) * (1 + confidence / np.sqrt(end)) ** 2 if end < dim else 1
        return bound[of] * scale * (1 + 1e-5) + 1e-6

    for first in range(0, len(rows), SLICE):
        own = rows[first : first + SLICE]
        end = min(dim, block)
        q, r = queries[:, :end], own[:, :end]
        part = (q**2).sum(1)[:, None] + (r**2).sum(1) - 2 * (q @ r.T)
        qi, ri = np.nonzero(part <= limit(end, np.arange(len(queries)))[:, None])
        part = part[qi, ri]
        for at in range(block, dim, block):
            end = min(dim, at + block)
            part = part + ((own[ri, at:end] - queries[qi, at:end]) ** 2).sum(1)
            stay = part <= limit(end, qi)
            qi, ri, part = qi[stay], ri[stay], part[stay]
        kept.append((qi, ri + first))
        qi, of, part = (np.concatenate(x) for x in zip(best, (qi, ids[ri + first], part), strict=True))
        order = np.lexsort((part, of, qi))  # the nearest of each id
        order = order[np.concatenate([[True], (qi[order][1:] != qi[order][:-1]) | (of[order][1:] != of[order][:-1])])] if len(order) else order
        order = order[np.lexsort((part[order], qi[order]))]
        place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
        last = order[place == k]
        bound[qi[last]] = np.minimum(bound[qi[last]], part[last])
        order = order[place <= k]
        best = qi[order], of[order], part[order]
    qi, ri = (np.concatenate(x) for x in zip(*kept, strict=True))
    return qi, ri


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. Both sides: vec_id, embedding."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)

    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows, queries = usable(vectors), usable(queries)
    by_dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_dim is None:
        return spark.createDataFrame([], schema)
    dim, total = by_dim["d"], by_dim["count"]
    rows, queries = rows.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    some = np.array([r.v for r in sampled])
    turn = rotation(dim)
    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS)))
    centres = fit_centres(_unit(some).astype(np.float32) @ turn, lists)
    lists = len(centres)
    probes = min(lists, max(MIN_PROBES, int(PROBE_SHARE * lists)))
    each = np.sort(np.unique([r.vec_id for r in sampled], return_index=True)[1])[:SEEDS]  # at most one has a query's id
    seeds = np.unique(_unit(some[each]), axis=0).astype(np.float32) @ turn
    shipped = spark.sparkContext.broadcast((centres, turn, seeds))

    # equal vectors are one candidate with up to 2 k ids, each up to k times
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    candidates = candidates.withColumn("n", F.row_number().over(same)).where(F.col("n") <= 2 * k).groupBy("v").agg(F.slice(F.flatten(F.sort_array(F.collect_list(F.array_repeat("vec_id", F.col("times"))))), 1, 2 * k).alias("ids"))
    # queries with equal vectors are searched once
    asked = queries.select("v").distinct().select(F.xxhash64("v").alias("asked"), "v")

    def nearest_lists(n: int):
        @F.pandas_udf("array<int>")
        def listed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c, turned, _ = shipped.value
            for part in parts:
                if not len(part):
                    yield pd.Series([], dtype=object)
                    continue
                sim = _unit(np.stack(part.to_numpy())).astype(np.float32) @ turned @ c.T
                best = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))
                yield pd.Series(list(best.astype(np.int32)))

        return listed

    @F.pandas_udf("float")
    def first_bound(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Squared distance to the k-th best other row among the seeds, which are rows themselves."""
        _, turned, seeds = shipped.value
        for part in parts:
            if not len(part) or len(seeds) <= k:
                yield pd.Series(np.full(len(part), 4.0, np.float32))
                continue
            x = _unit(np.stack(part.to_numpy())).astype(np.float32) @ turned
            yield pd.Series(np.partition(2 - 2 * (x @ seeds.T), k, axis=1)[:, k].astype(np.float32))

    # lists are dealt out in chunks of candidates and of queries, both of bounded size
    candidates = candidates.select("ids", "v", nearest_lists(1)("v")[0].alias("list"))
    asked = asked.select("asked", "v", first_bound("v").alias("bound"), F.explode(nearest_lists(probes)("v")).alias("list"))
    rows_in, asked_in = ({r["list"]: r["count"] for r in x.groupBy("list").count().collect()} for x in (candidates, asked))

    def chunks(sizes: dict[int, int]):
        n = [max(1, -(-sizes.get(i, 0) // CHUNK_ROWS)) for i in range(lists)]
        return F.array(*map(F.lit, n))[F.col("list")] if len(set(n)) > 1 else F.lit(n[0])

    def dealt(df: DataFrame, mine: str, mine_n, other: str, other_n) -> DataFrame:
        df = df.withColumn(mine, F.pmod(F.xxhash64("v"), mine_n).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1)))

    row_n, asked_n = chunks(rows_in), chunks(asked_in)
    candidates = dealt(candidates.select(F.lit(False).alias("is_query"), F.lit(0).cast("bigint").alias("asked"), "ids", "v", F.lit(0.0).cast("float").alias("bound"), "list"), "row_chunk", row_n, "asked_chunk", asked_n)
    asked = dealt(asked.select(F.lit(True).alias("is_query"), "asked", F.array().cast("array<bigint>").alias("ids"), "v", "bound", "list"), "asked_chunk", asked_n, "row_chunk", row_n)

    def scanned(pdf: pd.DataFrame) -> pd.DataFrame:
        isq = pdf["is_query"].to_numpy(bool)
        out = {"asked": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if isq.any() and not isq.all():
            raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # powers of two leave a cosine as it is
            turned = _unit(raw).astype(np.float32) @ shipped.value[1]
            ids, asked_ids = pdf["ids"].to_numpy()[~isq], pdf["asked"].to_numpy()[isq].astype(np.int64)
            rows_raw, q_raw = raw[~isq], raw[isq]
            qi, ri = scan(turned[isq], turned[~isq], pdf["bound"].to_numpy(np.float32)[isq], np.array([x[0] for x in ids], np.int64), k)
            score = np.einsum("ij,ij->i", rows_raw[ri], q_raw[qi]) / (np.sqrt((rows_raw**2).sum(1))[ri] * np.sqrt((q_raw**2).sum(1))[qi])
            n = np.array([len(x) for x in ids], int)
            got = np.concatenate([ids[i] for i in ri]) if len(ri) else np.zeros(0, np.int64)
            qi, score = np.repeat(qi, n[ri]), np.repeat(score, n[ri])
            order = np.lexsort((-score, got, qi))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (got[order][1:] != got[order][:-1]) | (qi[order][1:] != qi[order][:-1])
            first = np.flatnonzero(fresh)
            order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
            order = order[np.lexsort((got[order], -score[order], qi[order]))]
            place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
            order = order[place < 2 * k]
            out = {"asked": asked_ids[qi[order]], "vec_id": got[order].astype(np.int64), "score": score[order]}
        return pd.DataFrame(out)

    found = candidates.unionByName(asked).groupBy("list", "row_chunk", "asked_chunk").applyInPandas(scanned, "asked bigint, vec_id bigint, score double")
    of_id = Window.partitionBy("asked", "vec_id").orderBy(F.desc("score"))
    found = found.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= k)
    top = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= 2 * k)
    lists_of = found.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    owners = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("asked")).distinct()
    own = F.filter("top", lambda x: x["vec_id"] != F.col("query_id"))
    joined = owners.join(lists_of, "asked").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    return joined.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def op5_dimension_scan(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
