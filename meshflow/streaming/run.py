"""Running a stream over what is there now, into files that can be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master without it, as in tests, a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="meshflow")


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None, timeout: float = 600) -> DataFrame:
    """The rows of all micro-batches (complete mode: of the last). A batch that runs again overwrites its own files."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"

    def written(batch: DataFrame, number: int) -> None:
        part = "batch=0" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{part}")

    query = stream.writeStream.outputMode(mode).foreachBatch(written).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout} s")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/batch=*")
