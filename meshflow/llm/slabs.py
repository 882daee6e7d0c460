"""Arrow batches as byte slabs, and rolling hashes over them.

Operators that work on bytes or words look at many texts at once: a slab is the UTF-8 bytes of
consecutive rows in one buffer. Slabs are bounded by bytes, so memory doesn't grow with a batch;
one text longer than the bound forms a slab of its own, as texts are never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slab.
SLAB_BYTES = 1 << 19

_libc = ctypes.CDLL(None)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on between tasks."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


#: Words of more bytes are hashed by BLAKE2.
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(batch: pa.RecordBatch, column: str = "text", limit: int = SLAB_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes and offsets of their texts; each row is in one part."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    trim()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse modulo 2**64 to the powers 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for k, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
        if size > 1 << 23:  # one very long text; don't hold its tables
            return _powers.pop(0), _powers.pop(1)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with which range_hash() gives the hash of any range of the bytes."""
    up, _ = powers(len(data))
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=p[1:])
    return p


def range_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start up to end, alike wherever the bytes stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word, and its row.

    A word is a longest run of 0-9, a-z (A-Z count as these) and characters above U+007F.
    """
    low = _LOWER[data]
    inside = _WORD[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words. Long ones take a cryptographic hash: rolling hashes modulo 2**64 have known collisions there."""
    h = range_hash(prefix_hash(low), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word. A slab of one very long text is read in pieces that end between words."""
    if len(offsets) > 2 or len(data) <= 2 * SLAB_BYTES:
        low, starts, ends, row = words(data, offsets)
        return word_hashes(low, starts, ends), row
    out, first = [], 0
    while first < len(data):
        last = min(len(data), first + SLAB_BYTES)
        while last < len(data) and _WORD[_LOWER[data[last]]]:
            more = np.flatnonzero(~_WORD[_LOWER[data[last : last + 4096]]])
            last = last + int(more[0]) if len(more) else min(len(data), last + 4096)
        piece = data[first:last]
        low, starts, ends, _ = words(piece, np.array([0, len(piece)]))
        out.append(word_hashes(low, starts, ends))
        first = last
    h = np.concatenate(out)
    return h, np.zeros(len(h), np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    count = count.astype(np.int64)
    out = np.ones(int(count.sum()), np.int64)
    full = count > 0
    start, count = start[full].astype(np.int64), count[full]
    if not len(start):
        return out
    out[0] = start[0]
    out[np.cumsum(count)[:-1]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)
