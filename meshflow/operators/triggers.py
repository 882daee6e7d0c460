"""When callbacks fire, over stored arrays: AND, OR, and what is rejected.

Windows are computed over each array's own timesteps first; AND is then an equi-join on the timestep,
OR carries the latest window of every other array forward. The exact rule for arrivals in any order is
streaming.machine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fire_and(windows: Mapping[str, DataFrame]) -> DataFrame:
    """Timesteps at which all arrays advance. windows: prefix -> timestep and values; values get the prefix."""
    out = None
    for prefix, w in windows.items():
        w = w.select("timestep", *[F.col(c).alias(f"{prefix}_{c}") for c in w.columns if c != "timestep"])
        out = w if out is None else out.join(w, "timestep")
    return out


def fire_or(arrivals: DataFrame, names: Sequence[str], value: str = "total", order: Sequence[str] = ("timestep", "ord"), span: int = 1024) -> DataFrame:
    """Each arrival of any of the arrays with the latest value of all (null before an array's first).

    order starts with an integer column. Ranges of `span` of its numbers are handled on their own, and the last
    values of each range, one row a range, are carried into the later ones. Rows without that number are the last range.
    """
    of = arrivals.where(F.col("array_name").isin(*names)).withColumn("ord", F.array_position(F.array(*map(F.lit, names)), F.col("array_name")).cast("int"))
    of = of.withColumn("_range", F.call_function("div", F.col(order[0]) - F.pmod(F.col(order[0]), F.lit(span)), F.lit(span)))
    own = {n: F.when(F.col("array_name") == n, F.struct(F.col(value).alias("v"))) for n in names}
    last = of.groupBy("_range").agg(*(F.max_by(own[n], F.when(F.col("array_name") == n, F.struct(*order))).alias(f"_{n}") for n in names))
    earlier = Window.orderBy(F.col("_range").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("_range").alias("_of"), *(F.last_value(f"_{n}", True).over(earlier).alias(f"_{n}") for n in names))
    so_far = Window.partitionBy("_range").orderBy(*(F.col(c).asc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    latest = of.withColumns({f"_own_{n}": F.last_value(own[n], True).over(so_far) for n in names}).join(carried, F.col("_range").eqNullSafe(F.col("_of")))
    return latest.withColumns({f"{n}_{value}": F.coalesce(f"_own_{n}", f"_{n}")["v"] for n in names}).drop("_range", "_of", *(f"_own_{n}" for n in names), *(f"_{n}" for n in names))


def late(arrivals: DataFrame, order: str = "seq") -> DataFrame:
    """Arrivals whose timestep lies below one seen before for their array; an equal one is accepted."""
    before = Window.partitionBy("array_name").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("last_timestep", F.max("timestep").over(before)).where("timestep < last_timestep")


def repeated(arrivals: DataFrame) -> DataFrame:
    """Timesteps that arrive more than once for an array, and how often."""
    return arrivals.groupBy("array_name", "timestep").agg(F.count("*").alias("n_arrivals")).where("n_arrivals > 1")
