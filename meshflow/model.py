"""Schemas and declarations of the array engine.

A chunk is one producer's part of one array at one timestep: a row with its position, shape and its
cells in row-major order. Integer cells have a column of their own, as large integers don't fit doubles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())

CATALOG = T.StructType(
    [
        T.StructField("array_name", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("global_shape", _INTS),
        T.StructField("chunk_shape", _INTS),
        T.StructField("chunk_position", _INTS),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("array_name", T.StringType(), False),
        T.StructField("timestep", T.LongType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("chunk_position", _INTS),
        T.StructField("shape", _INTS),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
        T.StructField("data_long", T.ArrayType(T.LongType())),
        T.StructField("worker", T.StringType()),
    ]
)
FEEDBACK = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("timestep", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Window:
    """The last `size` arrays of one name."""

    name: str
    size: int = 1


@dataclass(frozen=True)
class ArraySpec:
    """What a producer declares about one of its arrays."""

    global_shape: tuple[int, ...]
    chunk_shape: tuple[int, ...]
    chunk_position: tuple[int, ...]

    @staticmethod
    def of(spec: ArraySpec | Mapping[str, Sequence[int]]) -> ArraySpec:
        if isinstance(spec, ArraySpec):
            return spec
        missing = {"global_shape", "chunk_shape", "chunk_position"} - set(spec)
        if missing:
            raise ValueError(f"missing: {', '.join(sorted(missing))}")
        return ArraySpec(*(tuple(map(int, spec[k])) for k in ("global_shape", "chunk_shape", "chunk_position")))

    def validate(self, name: str) -> ArraySpec:
        """Equal ranks of at least 1, no negative extent, chunks that tile the array; else ValueError."""
        dims = len(self.global_shape)
        if not dims or dims != len(self.chunk_shape) or dims != len(self.chunk_position):
            raise ValueError(f"array {name}: shapes and position need the same number of dimensions, at least 1")
        if min(self.global_shape) < 0 or min(self.chunk_shape) < 0 or min(self.chunk_position) < 0:
            raise ValueError(f"array {name}: negative extent or position")
        if any(c == 0 and g != 0 or c and g % c for g, c in zip(self.global_shape, self.chunk_shape, strict=True)):
            raise ValueError(f"array {name}: chunks of {self.chunk_shape} don't tile {self.global_shape}")
        return self

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(g // c if c else 0 for g, c in zip(self.global_shape, self.chunk_shape, strict=True))

    @property
    def n_blocks(self) -> int:
        return prod(self.grid)
