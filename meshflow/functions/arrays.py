"""Array algebra over chunk rows. Reductions work on the chunk's array where no cell index is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_sum(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda s, x: s + x)


def _all(value: str | Column = "value") -> list[Column]:
    """Aggregates of cells; the moments are merged from means and squared deviations, so that large means don't cost digits."""
    x = F.col(value) if isinstance(value, str) else value
    return [
        F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("smallest"), F.max(x).alias("largest"),
        F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std"),
    ]


def reduce_all(chunks: DataFrame, data: str = "data", by: Sequence[str] = ()) -> DataFrame:
    """n, total, mean, smallest, largest, variance (ddof 0), std of all cells; partial values are made before the shuffle."""
    return chunks.select(*by, F.explode(data).alias("_cell")).groupBy(*by).agg(*_all("_cell"))


def product(chunks: DataFrame, data: str = "data", by: Sequence[str] = ()) -> DataFrame:
    """product of all cells."""
    own = F.aggregate(data, F.lit(1.0), lambda s, x: s * x)
    return chunks.groupBy(*by).agg(F.product(own).alias("product"))


def any_cell(condition: Callable[[Column], Column], data: str = "data") -> Column:
    """Aggregate: whether a cell meets the condition; false for no cells."""
    return F.coalesce(F.bool_or(F.exists(data, condition)), F.lit(False))


def all_cells(condition: Callable[[Column], Column], data: str = "data") -> Column:
    """Aggregate: whether all cells meet the condition; true for no cells."""
    return F.coalesce(F.bool_and(F.forall(data, condition)), F.lit(True))


def arg_extremes(cells: DataFrame, axes: Sequence[str], value: str = "value") -> DataFrame:
    """Indices of the smallest and largest cell; the first in row-major order among equals."""
    at = F.struct(*axes)
    low = F.min(F.struct(F.col(value).alias("v"), at.alias("at")))
    high = F.min(F.struct((-F.col(value)).alias("v"), at.alias("at")))
    out = cells.agg(low.alias("lo"), high.alias("hi"))
    return out.select(*[F.col(f"lo.at.{a}").alias(f"min_{a}") for a in axes], F.col("lo.v").alias("smallest"), *[F.col(f"hi.at.{a}").alias(f"max_{a}") for a in axes], (-F.col("hi.v")).alias("largest"))


def reduce_axes(cells: DataFrame, keep: Sequence[str], value: str = "value") -> DataFrame:
    """n, total, mean, smallest, largest, variance, std over the axes that aren't kept."""
    return cells.groupBy(*keep).agg(*_all(value))


def any_all_axes(cells: DataFrame, keep: Sequence[str], condition: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """any_cell and all_cells over the axes that aren't kept."""
    met = condition(F.col(value))
    return cells.groupBy(*keep).agg(F.bool_or(met).alias("any_cell"), F.bool_and(met).alias("all_cells"))


def arg_axes(cells: DataFrame, keep: Sequence[str], axis: str, value: str = "value") -> DataFrame:
    """arg_smallest and arg_largest along an axis; the first among equals."""
    low, high = F.min(F.struct(F.col(value), F.col(axis).alias("_at"))), F.min(F.struct(-F.col(value), F.col(axis).alias("_at")))
    return cells.groupBy(*keep).agg(low["_at"].alias("arg_smallest"), high["_at"].alias("arg_largest"))


def take(cells: DataFrame, slices: dict[str, slice], shape: dict[str, int]) -> DataFrame:
    """The cells of a slice along each named axis, with indices from 0; filters reach the scan where indices are its columns."""
    out = cells
    for axis, s in slices.items():
        first, stop, step = s.indices(shape[axis])
        if step < 0:
            raise ValueError("steps are positive")
        inside = (F.col(axis) >= first) & (F.col(axis) < stop)
        if step > 1:
            inside &= F.pmod(F.col(axis) - first, F.lit(step)) == 0
        out = out.where(inside).withColumn(axis, F.call_function("div", F.col(axis) - first, F.lit(step)).cast(cells.schema[axis].dataType))
    return out


def elementwise(chunks: DataFrame, fn: Callable[[Column], Column], data: str = "data") -> DataFrame:
    return chunks.withColumn(data, F.transform(data, fn))


def binary(left: DataFrame, right: DataFrame, on: Sequence[str], fn: Callable[[Column, Column], Column], data: str = "data") -> DataFrame:
    """Cellwise fn of two arrays with equal chunking, chunk by chunk."""
    other = right.select(*on, F.col(data).alias("_other"))
    return left.join(other, list(on)).withColumn(data, F.zip_with(data, "_other", fn)).drop("_other")


def all_equal(left: DataFrame, right: DataFrame, on: Sequence[str], data: str = "data") -> DataFrame:
    """One row, equal: whether both have the same chunks with equal cells."""
    a, b = left.select(*on, F.col(data).alias("_a")), right.select(*on, F.col(data).alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return a.join(b, list(on), "full_outer").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def _with_type(schema: T.StructType, column: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in schema.fields])


def map_blocks(chunks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], shape: Sequence[int], data: str = "data", to: str | None = None) -> DataFrame:
    """fn of each chunk as an ndarray of this shape, whose buffer isn't copied on the way in.

    Cells stay of their type, or become `to` (double or bigint); ValueError where a result isn't whole then.
    """
    element = chunks.schema[data].dataType.elementType
    kind = {"double": T.DoubleType(), "bigint": T.LongType()}[to] if to else element
    whole = isinstance(kind, T.IntegralType)
    at, cell = chunks.columns.index(data), pa.int64() if isinstance(kind, T.LongType) else pa.int32() if whole else pa.float64()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = []
            for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True):
                y = np.asarray(fn(flat[a:b].reshape(shape))).ravel() if ok else None
                if ok and whole and y.dtype.kind not in "iub":
                    if not (y == np.floor(y)).all():
                        raise ValueError("results aren't whole: give the type of cells")
                    y = y.astype(np.int64)
                out.append(y)
            columns = batch.columns
            columns[at] = pa.array(out, pa.list_(cell))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return chunks.mapInArrow(mapped, _with_type(chunks.schema, data, T.ArrayType(kind)))


def histogram(cells: DataFrame, low: float, high: float, bins: int, value: str = "value") -> DataFrame:
    """bin and n; the upper end belongs to the last bin, cells outside are left out."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins))
    inside = cells.where(F.col(value).between(low, high))
    return inside.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def gram_matrix(rows: DataFrame, data: str = "data") -> DataFrame:
    """Product of the transposed matrix with itself, from its rows: i, j, value. Tasks add up products of batches."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column(0)
            if len(lists):
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = rows.select(F.col(data).cast("array<double>").alias("x")).mapInArrow(products, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def matmul(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Product of two matrices of cells (i0, i1, value): i0, i1, value."""
    a = left.select("i0", F.col("i1").alias("_k"), F.col(value).alias("_a"))
    b = right.select(F.col("i0").alias("_k"), "i1", F.col(value).alias("_b"))
    return a.join(b, "_k").groupBy("i0", "i1").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))


def dot(left: DataFrame, right: DataFrame, on: Sequence[str], data: str = "data") -> DataFrame:
    """Sum of products of the cells of two arrays with equal chunking."""
    return binary(left, right, on, lambda a, b: a * b, data).agg(F.sum(chunk_sum(F.col(data))).alias("dot"))


def stencil(cells: DataFrame, axes: str | Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Adds laplacian: the sum over the axes of left + right - 2 x; null at the borders. by: the other columns of a line."""
    axes = [axes] if isinstance(axes, str) else list(axes)
    total = None
    for axis in axes:
        line = Window.partitionBy(*by, *(a for a in axes if a != axis)).orderBy(axis)
        part = F.lag(value).over(line) + F.lead(value).over(line) - 2 * F.col(value)
        total = part if total is None else total + part
    return cells.withColumn("laplacian", total)


def quantiles(cells: DataFrame, by: Sequence[str], at: Sequence[float], value: str = "value", parts: int = 64) -> DataFrame:
    """Exact quantiles, interpolated linearly: by, q, quantile.

    Approximate ones cut each group's values into `parts` ranges; the ranges' counts tell which hold the wanted
    ranks, and only these are ordered, by distinct value. No task sees a whole group.
    """
    x = F.col(value)
    rows = cells.where(x.isNotNull())
    cuts = rows.groupBy(*by).agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 1000).alias("_cuts"), F.count("*").alias("_n"))
    place = F.size(F.filter("_cuts", lambda c: c < x)).alias("_part")
    # counts of distinct values, before anything is ordered
    counts = rows.join(cuts, list(by)).groupBy(*by, place, x.alias("_x")).agg(F.count("*").alias("_c"))
    per = counts.groupBy(*by, "_part").agg(F.sum("_c").alias("_of"))
    earlier = F.coalesce(F.sum("_of").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", earlier)
    asked = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("r")) for q in at))).alias("_a")
    wanted = cuts.select(*by, asked).select(*by, "_a.q", "_a.r").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("r"), F.ceil("r")))))
    wanted = wanted.join(per, list(by)).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_of"))).select(*by, "q", "r", "rank", "_part", "_before")
    inside = counts.join(wanted.select(*by, "_part", "_before").distinct(), [*by, "_part"])
    upto = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_last", F.col("_before") + upto)
    met = wanted.drop("_before").join(inside, [*by, "_part"]).where((F.col("rank") < F.col("_last")) & (F.col("rank") >= F.col("_last") - F.col("_c")))
    low, high = F.min_by("_x", "rank"), F.max_by("_x", "rank")
    share = F.first("r") - F.floor(F.first("r"))
    return met.groupBy(*by, "q").agg((low + (high - low) * share).alias("quantile"))


def to_ndarray(cells: DataFrame, shape: Sequence[int], limit: int = 50_000_000, value: str = "value", dtype: str | None = None) -> np.ndarray:
    """The array on the driver, with the cells' own type unless `dtype` is given; ValueError beyond `limit` cells."""
    if np.prod(shape) > limit:
        raise ValueError(f"{tuple(shape)} is too large for the driver")
    table = cells.toArrow()
    found = table.column(value).to_numpy()
    out = np.full(tuple(shape), np.nan) if found.dtype.kind == "f" else np.zeros(tuple(shape), found.dtype)
    out[tuple(table.column(f"i{d}").to_numpy() for d in range(len(shape)))] = found
    return out if dtype is None else out.astype(dtype)
