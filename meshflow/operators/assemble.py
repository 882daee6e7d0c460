"""From chunks to global arrays: completeness, block order, tiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshflow.functions.grid import coords


def counted(chunks: DataFrame, *aggregates: Column) -> DataFrame:
    """n_chunks, and other aggregates, for each array and timestep; partial sums are made before the shuffle."""
    return chunks.groupBy("array_name", "timestep").agg(F.count("*").alias("n_chunks"), *aggregates)


def complete(per_timestep: DataFrame, expected: DataFrame | int) -> DataFrame:
    """Timesteps that have all their chunks. expected: a number, or array_name and n_ranks (small)."""
    if isinstance(expected, int):
        return per_timestep.where(F.col("n_chunks") == expected)
    return per_timestep.join(expected.select("array_name", "n_ranks"), "array_name").where("n_chunks = n_ranks").drop("n_ranks")


def incomplete(per_timestep: DataFrame, expected: DataFrame | int) -> DataFrame:
    """Timesteps that lack chunks; they stay pending."""
    if isinstance(expected, int):
        return per_timestep.where(F.col("n_chunks") < expected)
    return per_timestep.join(expected.select("array_name", "n_ranks"), "array_name").where("n_chunks < n_ranks").drop("n_ranks")


def missing(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """(array_name, timestep, rank) that was declared but not sent, for timesteps that have begun."""
    begun = chunks.select("array_name", "timestep").distinct()
    due = begun.join(catalog.select("array_name", "rank").distinct(), "array_name")
    return due.join(chunks.select("array_name", "timestep", "rank"), ["array_name", "timestep", "rank"], "left_anti")


def block_index(chunks: DataFrame) -> DataFrame:
    """Adds block_index: the place of a chunk by position, ties by rank; chunks without a position come last."""
    order = Window.partitionBy("array_name", "timestep").orderBy(F.col("chunk_position").asc_nulls_last(), F.col("rank").asc_nulls_last())
    return chunks.withColumn("block_index", F.row_number().over(order) - 1)


def layout(chunks: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Adds block_index and its grid coordinates g0, g1, ..."""
    return block_index(chunks).withColumns({f"g{d}": c for d, c in enumerate(coords(F.col("block_index"), grid))})


def tile_errors(per_timestep: DataFrame, n_blocks: int) -> DataFrame:
    """Timesteps whose number of blocks doesn't fill the grid, with what it should be."""
    return per_timestep.where(F.col("n_chunks") != n_blocks).withColumn("expected", F.lit(n_blocks).cast("bigint"))


def cells(blocks: DataFrame, block_shape: Sequence[int], grid: Sequence[int], data: str = "data") -> DataFrame:
    """One row for each cell: the other columns, its global indices i0, i1, ... and value."""
    rest = [c for c in blocks.columns if c not in (data, "block_index")]
    out = blocks.select(*rest, "block_index", F.posexplode(data).alias("_local", "value"))
    at = [g.cast("bigint") * n + i for g, n, i in zip(coords(F.col("block_index"), grid), block_shape, coords(F.col("_local"), block_shape), strict=True)]
    return out.select(*rest, *[c.alias(f"i{d}") for d, c in enumerate(at)], "value")
