"""The chunk log: what producers send, as Parquet files that batch and streaming readers share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshflow.model import CHUNKS


def chunk_row(array_name: str, timestep: int, rank: int, seq: int, position: Iterable[int], chunk: np.ndarray, worker: str | None = None) -> tuple:
    """A row of CHUNKS; integer cells keep 64 bits."""
    chunk = np.asarray(chunk)
    whole = chunk.dtype.kind in "iub"
    cells = chunk.ravel().tolist()
    return (array_name, int(timestep), int(rank), int(seq), [int(x) for x in position], list(chunk.shape), str(chunk.dtype), None if whole else [float(x) for x in cells], [int(x) for x in cells] if whole else None, worker)


def _lists(chunks: list[np.ndarray | None], dtype) -> pa.Array:
    """Flat cells of each chunk, from its buffer; None where there is no chunk."""
    flat = [np.zeros(0, dtype) if c is None else np.ascontiguousarray(c, dtype).ravel() for c in chunks]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)), mask=pa.array([c is None for c in chunks]))


def _escaped(name: str) -> str:
    """As Spark names the folder of a partition."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\{[]^\x7f" else c for c in name)


class ChunkWriter:
    """Appends chunks from any process, without Spark: a file for each array of a batch, which appears when it is whole."""

    def __init__(self, root: str):
        self.fs, self.path = fs.FileSystem.from_uri(root)

    def append(self, rows: list[tuple]) -> None:
        """rows: array_name, timestep, rank, seq, position, chunk, worker."""
        for name in dict.fromkeys(r[0] for r in rows):
            own = [r for r in rows if r[0] == name]
            chunks = [np.asarray(r[5]) for r in own]
            whole = [c.dtype.kind in "iub" for c in chunks]
            table = pa.table(
                {
                    "timestep": pa.array([r[1] for r in own], pa.int64()),
                    "rank": pa.array([r[2] for r in own], pa.int32()),
                    "seq": pa.array([r[3] for r in own], pa.int64()),
                    "chunk_position": pa.array([list(r[4]) for r in own], pa.list_(pa.int32())),
                    "shape": pa.array([list(c.shape) for c in chunks], pa.list_(pa.int32())),
                    "dtype": pa.array([str(c.dtype) for c in chunks]),
                    "data": _lists([None if w else c for c, w in zip(chunks, whole, strict=True)], np.float64),
                    "data_long": _lists([c if w else None for c, w in zip(chunks, whole, strict=True)], np.int64),
                    "worker": pa.array([r[6] for r in own], pa.string()),
                }
            )
            folder = f"{self.path}/array_name={_escaped(name)}"
            self.fs.create_dir(folder)
            part = uuid.uuid4().hex
            with self.fs.open_output_stream(f"{folder}/.{part}") as f:
                pq.write_table(table, f)
            self.fs.move(f"{folder}/.{part}", f"{folder}/{part}.parquet")


class ChunkLog:
    """Rows of CHUNKS under one folder, partitioned by array so that subscriptions prune."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ChunkWriter(path).fs.create_dir(ChunkWriter(path).path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(self.path)

    def stream(self, max_files: int | None = None) -> DataFrame:
        """Arrays are told by their files' paths, as a stream that starts before the first file finds no partitions."""
        reader = self.spark.readStream.schema(T.StructType([f for f in CHUNKS.fields if f.name != "array_name"])).option("recursiveFileLookup", "true")
        rows = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(self.path)
        name = F.regexp_extract("_metadata.file_path", "array_name=([^/]*)", 1)
        for _ in range(2):  # the path's own escapes, and those of _escaped()
            name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        return rows.select(name.alias("array_name"), *(f.name for f in CHUNKS.fields if f.name != "array_name"))

    def of(self, array_name: str, timestep: int) -> DataFrame:
        return self.read().where((F.col("array_name") == array_name) & (F.col("timestep") == timestep))
