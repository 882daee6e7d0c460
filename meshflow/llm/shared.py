"""What operators share on a cluster: where lineage is cut, and joins that no single key can stop."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task, at least; and the most keys that are broadcast.
SPREAD, MOST_HEAVY = 256, 2000
#: Short rows of a partition of a settled table.
ROWS_EACH = 100_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without it, as in tests, a folder of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return named or sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of whichever file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of so many rows in what runs meanwhile, as rows that hold texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def settle_rows(df: DataFrame, each: int = ROWS_EACH) -> DataFrame:
    """settle() for rows of a few numbers, in as many partitions as their count asks for: tables that shrink to little
    don't go on in thousands of near-empty tasks and files."""
    df = settle(df)
    return df.coalesce(max(1, -(-df.count() // each)))


def heavy_from(rows: int) -> int:
    """Keys with more rows than this are heavy; of `rows` rows no more than MOST_HEAVY keys can be."""
    return max(SPREAD, -(-rows // MOST_HEAVY))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, heavy: DataFrame | None = None) -> DataFrame:
    """Inner join with right, which has one short row for each key; left has `rows` rows.

    Rows of left whose key is heavy stay where they are and look it up in a broadcast of at most
    MOST_HEAVY rows; the others are shuffled by key. heavy: the heavy keys, where they are known already.
    """
    if heavy is None:
        heavy = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_from(rows))
    heavy = F.broadcast(heavy.select(*keys))
    known = right.join(heavy, keys, "left_semi")
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]
    found = left.join(F.broadcast(known), keys).select(*columns)
    return found.unionAll(left.join(heavy, keys, "left_anti").join(right, keys).select(*columns))
