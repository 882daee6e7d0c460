"""Count-based trailing windows over each array's own timesteps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(size: int, order: str = "timestep"):
    """The last `size` rows of an array, fewer at its start; rows without a place in the order come last."""
    if size < 1:
        raise ValueError("a window holds at least one array")
    return Window.partitionBy("array_name").orderBy(F.col(order).asc_nulls_last()).rowsBetween(1 - size, 0)


def trailing(arrays: DataFrame, size: int = 1, order: str = "timestep", **aggregates: Column) -> DataFrame:
    """Adds one column for each aggregate over the frame; one sort by array serves all."""
    return arrays.withColumns({name: a.over(frame(size, order)) for name, a in aggregates.items()})


def trailing_by_name(arrays: DataFrame, sizes: Mapping[str, int], value: str, order: str = "timestep") -> DataFrame:
    """n_in_window and window_sum with a window size for each array name; other arrays are left out."""
    held = F.collect_list(F.col(value)).over(frame(max(sizes.values()), order))
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])[F.col("array_name")]
    own = arrays.where(F.col("array_name").isin(*sizes)).withColumn("_held", held).withColumn("_n", F.least(size, F.size("_held")))
    last = F.slice("_held", F.size("_held") - F.col("_n") + 1, F.col("_n"))
    total = F.aggregate(last, F.lit(0.0), lambda s, x: s + x)
    return own.select(*arrays.columns, F.col("_n").cast("bigint").alias("n_in_window"), total.alias("window_sum"))
