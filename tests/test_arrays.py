"""Tiling, grids and array algebra against numpy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshflow.functions import arrays as A
from meshflow.functions import grid
from meshflow.model import CHUNKS, ArraySpec
from meshflow.operators import assemble, catalog, feedback, triggers, windows
from meshflow.sources.chunk_log import chunk_row

SHAPES = [((7,), (1,)), ((8, 8), (4, 4)), ((32, 16), (16, 16)), ((16, 32), (8, 1)), ((8, 8, 4), (4, 2, 4)), ((4, 8, 8), (1, 8, 4))]


def chunks_of(spark, x, block, dtype=None):
    grid_of = [g // b for g, b in zip(x.shape, block)]
    rows = []
    for rank, at in enumerate(itertools.product(*map(range, grid_of))):
        part = x[tuple(slice(a * b, (a + 1) * b) for a, b in zip(at, block))]
        rows.append(chunk_row("x", 0, rank, rank, at, part))
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, CHUNKS), grid_of


@pytest.mark.parametrize("shape,block", SHAPES)
def test_tiling(spark, shape, block):
    x = np.random.default_rng(42).random(shape)
    chunks, grid_of = chunks_of(spark, x, block)
    cells = assemble.cells(assemble.block_index(chunks).select("block_index", "data"), block, grid_of)
    assert np.array_equal(A.to_ndarray(cells, shape), x)


def test_too_large_for_the_driver(spark):
    with pytest.raises(ValueError):
        A.to_ndarray(spark.range(1), (10, 10), limit=5)


def test_reductions(spark):
    x = np.random.default_rng(1).random((8, 8))
    chunks, grid_of = chunks_of(spark, x, (4, 4))
    got = A.reduce_all(chunks).first()
    assert np.allclose([got.total, got.mean, got.smallest, got.largest, got.variance, got["std"]], [x.sum(), x.mean(), x.min(), x.max(), x.var(), x.std()])
    cells = assemble.cells(assemble.block_index(chunks).select("block_index", "data"), (4, 4), grid_of)
    by = A.reduce_axes(cells, ["i1"]).orderBy("i1").toPandas()
    assert np.allclose(by["total"], x.sum(0)) and np.allclose(by["largest"], x.max(0))
    at = A.arg_extremes(cells, ["i0", "i1"]).first()
    assert (at.min_i0, at.min_i1) == np.unravel_index(x.argmin(), x.shape) and (at.max_i0, at.max_i1) == np.unravel_index(x.argmax(), x.shape)
    assert chunks.agg(A.any_cell(lambda v: v > 2), A.all_cells(lambda v: v < 2)).first() == (False, True)
    mapped = A.map_blocks(chunks, lambda b: b * 2, (4, 4))
    assert np.isclose(A.reduce_all(mapped).first().total, 2 * x.sum())
    assert A.all_equal(chunks, mapped, ["rank"]).first().equal is False
    assert A.all_equal(mapped, A.binary(chunks, chunks, ["rank"], lambda a, b: a + b), ["rank"]).first().equal is True
    g = A.gram_matrix(spark.createDataFrame([(r.tolist(),) for r in x], "data array<double>")).toPandas()
    out = np.zeros((8, 8))
    out[g.i, g.j] = g.value
    assert np.allclose(out, x.T @ x)


def test_grid(spark):
    dims = (2, 3, 4)
    row = spark.range(24).select("id", *[c.alias(f"c{d}") for d, c in enumerate(grid.coords(F.col("id"), dims))]).orderBy("id").toPandas()
    assert np.array_equal(row[["c0", "c1", "c2"]].to_numpy(), np.stack(np.unravel_index(np.arange(24), dims), 1))
    one = spark.createDataFrame([(-1, 0), (1, 5), (1, 3)], "a int, b int")
    got = [r[0] for r in one.select(grid.rank_of((F.col("a"), F.col("b")), (2, 4), (True, False))).collect()]
    assert got == [4, None, 7]


def test_specs():
    for bad in [((), (), ()), ((4,), (3,), (0,)), ((4, 4), (2,), (0,)), ((4,), (2,), (-1,))]:
        with pytest.raises(ValueError):
            ArraySpec(*bad).validate("x")
    with pytest.raises(ValueError):
        ArraySpec.of({"global_shape": (1,)})
    assert ArraySpec((0,), (0,), (0,)).validate("x").n_blocks == 0
    assert ArraySpec.of({"global_shape": [8, 8], "chunk_shape": [4, 4], "chunk_position": [0, 1]}).n_blocks == 4


def test_integers_stay_exact(spark):
    big = 1_700_000_000_123_456_789
    row = spark.createDataFrame([chunk_row("x", 0, 0, 0, (0,), np.array([big]))], CHUNKS).first()
    assert row.data is None and row.data_long == [big] and row.dtype == "int64"


def test_catalog(spark):
    c = spark.createDataFrame([("a", 1, "late"), ("a", 0, "first"), ("b", 1, "own")], "array_name string, rank int, shape string")
    assert {(r.array_name, r["shape"]) for r in catalog.merge(c).collect()} == {("a", "first"), ("b", "own")}
    assert [(r.array_name, r["rank"]) for r in catalog.single_owner(c).collect()] == [("b", 1)]
    assert {r.array_name: r.ranks for r in catalog.participation(c).collect()} == {"a": [0, 1], "b": [1]}
    sent = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 5, 1), ("b", 5, 7)], "array_name string, timestep bigint, rank int")
    assert [tuple(r) for r in assemble.missing(sent, c).select("array_name", "timestep", "rank").collect()] == [("a", 0, 0)]
    assert catalog.participants_only(sent, c).count() == 4


def test_feedback(spark):
    rows = [("k", i, i % 3, str(i)) for i in range(10)]
    fb = spark.createDataFrame(rows, "key string, seq bigint, timestep bigint, value string")
    assert sorted(r.seq for r in feedback.last_n(fb, 4).collect()) == [6, 7, 8, 9]
    asked = spark.createDataFrame([("k", 0), ("k", 7), ("other", 0)], "key string, timestep bigint")
    got = {(r.key, r.timestep): (r.value, r.found) for r in feedback.lookup(fb, asked, 4, "none").collect()}
    assert got == {("k", 0): ("6", True), ("k", 7): ("none", False), ("other", 0): ("none", False)}


def test_window_size_zero():
    with pytest.raises(ValueError):
        windows.frame(0)


def test_variance_of_large_means(spark):
    x = np.random.default_rng(4).normal(1e8, 1, (40, 5))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, data array<double>")
    assert np.isclose(A.reduce_all(rows).first().variance, x.var(), rtol=1e-6)
    per = {r.i: r.variance for r in A.reduce_all(rows, by=["i"]).collect()}
    assert np.allclose([per[i] for i in range(40)], x.var(1), rtol=1e-6)


def test_indices_beyond_32_bits(spark):
    blocks = spark.createDataFrame([(70_000, [1.0])], "block_index int, data array<double>")
    assert assemble.cells(blocks, (100_000,), (100_000,)).first().i0 == 7_000_000_000
    wide = spark.createDataFrame([(2**53 + 3,)], "i bigint").select(*grid.coords(F.col("i"), (2**31 - 1, 1 << 23)))
    assert tuple(wide.first()) == ((2**53 + 3) >> 23, 3)


def test_axes(spark):
    x = np.round(np.random.default_rng(5).normal(size=(6, 9)), 1)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(6) for j in range(9)], "i0 int, i1 int, value double")
    by = A.reduce_axes(cells, ["i0"]).orderBy("i0").toPandas()
    assert np.allclose(by["variance"], x.var(1)) and np.allclose(by["std"], x.std(1))
    met = A.any_all_axes(cells, ["i1"], lambda v: v > 0).orderBy("i1").toPandas()
    assert (met["any_cell"] == (x > 0).any(0)).all() and (met["all_cells"] == (x > 0).all(0)).all()
    at = A.arg_axes(cells, ["i0"], "i1").orderBy("i0").toPandas()
    assert (at["arg_smallest"] == x.argmin(1)).all() and (at["arg_largest"] == x.argmax(1)).all()
    cut = A.take(cells, {"i0": slice(1, -1, 2), "i1": slice(None, 7)}, {"i0": 6, "i1": 9})
    assert np.array_equal(A.to_ndarray(cut, x[1:-1:2, :7].shape), x[1:-1:2, :7])
    lap = A.to_ndarray(A.stencil(cells, ["i0", "i1"]).drop("value").withColumnRenamed("laplacian", "value").where("value is not null"), x.shape)
    want = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    assert np.allclose(lap[1:-1, 1:-1], want)
    product = A.matmul(cells, cells.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "value"))
    assert np.allclose(A.to_ndarray(product, (6, 6)), x @ x.T)


@pytest.mark.parametrize("parts", [2, 64])
def test_quantiles(spark, parts):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [300, 7]), "c": np.array([5.0]), "d": rng.integers(0, 4, 90).astype(float)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("e", None)], "k string, value double")
    got = {(r.k, r.q): r.quantile for r in A.quantiles(rows, ["k"], [0, 0.25, 0.5, 0.99, 1], parts=parts).collect()}
    assert got.keys() == {(k, q) for k in groups for q in (0, 0.25, 0.5, 0.99, 1)}
    assert all(np.isclose(v, np.quantile(groups[k], q)) for (k, q), v in got.items())


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_or_over_ranges(spark, span):
    rng = random.Random(2)
    rows = sorted({(rng.choice("xyz"), rng.randrange(40)) for _ in range(60)}, key=lambda r: (r[1], r[0]))
    table = spark.createDataFrame([(n, t, None if k % 7 == 0 else float(k)) for k, (n, t) in enumerate(rows)], "array_name string, timestep bigint, total double")
    got = triggers.fire_or(table, ["x", "y"], span=span).orderBy("timestep", "ord").collect()
    last, want = {}, []
    for k, (n, t) in enumerate(rows):
        if n != "z":
            last[n] = None if k % 7 == 0 else float(k)
            want.append((n, t, last.get("x"), last.get("y")))
    assert [(r.array_name, r.timestep, r.x_total, r.y_total) for r in got] == want


def test_map_blocks_keeps_whole_cells_whole(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None)], "i int, data array<bigint>")
    got = {r.i: r.data for r in A.map_blocks(rows, lambda b: b / 1, (2,)).collect()}
    assert got == {1: [1, 2], 2: None}
    assert A.map_blocks(rows, lambda b: b / 4, (2,), to="double").where("i = 1").first().data == [0.25, 0.5]
    with pytest.raises(Exception, match="whole"):
        A.map_blocks(rows, lambda b: b / 4, (2,)).collect()
