"""Declarations of all producers: merging, participation, single owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(catalog: DataFrame) -> DataFrame:
    """One row for each array: the declaration of the smallest rank that has it."""
    rest = [c for c in catalog.columns if c != "array_name"]
    return catalog.groupBy("array_name").agg(F.min_by(F.struct(*rest), "rank").alias("d")).select("array_name", "d.*")


def participation(catalog: DataFrame) -> DataFrame:
    """array_name, the sorted ranks that declare it, and how many."""
    ranks = F.sort_array(F.collect_set("rank"))
    return catalog.groupBy("array_name").agg(ranks.alias("ranks")).withColumn("n_ranks", F.size("ranks").cast("bigint"))


def single_owner(catalog: DataFrame) -> DataFrame:
    """Arrays that one rank alone declares, with that rank."""
    found = catalog.groupBy("array_name").agg(F.min("rank").alias("rank"), F.max("rank").alias("_last"))
    return found.where(F.col("rank") == F.col("_last")).drop("_last")


def participants_only(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks whose rank has declared their array; a null equals a null."""
    declared = catalog.select(F.col("array_name").alias("_name"), F.col("rank").alias("_rank")).distinct()
    return chunks.join(declared, F.col("array_name").eqNullSafe(F.col("_name")) & F.col("rank").eqNullSafe(F.col("_rank")), "left_semi")
