"""Row-major grids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n)) if n > 1 else a


def coords(index: Column, dims: Sequence[int]) -> list[Column]:
    """Coordinates of a row-major index; one beyond the grid goes on along the first axis."""
    over = [_div(index, prod(dims[d + 1 :])) for d in range(len(dims))]
    return [(c % F.lit(n) if d else c).cast("int") for d, (c, n) in enumerate(zip(over, dims, strict=True))]


def rank_of(at: Sequence[Column], dims: Sequence[int], periodic: Sequence[bool] | None = None) -> Column:
    """Row-major index of coordinates; periodic ones wrap, others give null out of bounds."""
    total, fine = F.lit(0), F.lit(True)
    for d, (c, n) in enumerate(zip(at, dims, strict=True)):
        wraps = bool(periodic and periodic[d])
        fine = fine if wraps else fine & (c >= 0) & (c < n)
        total = total + (F.pmod(c, F.lit(n)) if wraps else c) * prod(dims[d + 1 :])
    return F.when(fine, total.cast("int"))


def worker_of(timestep: Column, rank: Column, n: int) -> Column:
    """Round-robin place of a chunk among n workers."""
    return F.pmod(timestep + rank, F.lit(n)).cast("int")
