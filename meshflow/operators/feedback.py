"""Values that the analysis sends back to the producers: a bounded last-in list for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(feedback: DataFrame, n: int) -> DataFrame:
    """What a queue of n entries for each key still holds, oldest first by seq."""
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    return feedback.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def lookup(feedback: DataFrame, asked: DataFrame, n: int, default: str | None = None) -> DataFrame:
    """key, timestep, value, found for each asked (key, timestep): the first held value of that timestep."""
    first = last_n(feedback, n).groupBy("key", "timestep").agg(F.min_by(F.struct("value"), "seq").alias("v"))
    out = asked.join(first, ["key", "timestep"], "left")
    value = F.when(F.col("v").isNull(), F.lit(default)).otherwise(F.col("v.value"))
    return out.select("key", "timestep", value.alias("value"), F.col("v").isNotNull().alias("found"))
