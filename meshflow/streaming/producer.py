"""A producer: one rank of a simulation, in any process. It needs no Spark, only the shared folder."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

import numpy as np

from meshflow.model import ArraySpec
from meshflow.sources.chunk_log import ChunkWriter
from meshflow.streaming.control import Folder, wait_until


class Producer:
    """Chunks are written in batches of `buffer`, and at flush() and close()."""

    def __init__(self, root: str, rank: int, specs: Mapping[str, ArraySpec | Mapping], timeout: float = 10, wait_for_go: bool = True, buffer: int = 64):
        self.root, self.rank, self.buffer, self.closed = root, rank, buffer, False
        self.specs = {name: ArraySpec.of(s).validate(name) for name, s in specs.items()}
        self.control, self.writer = Folder(root, "control"), ChunkWriter(f"{root}/chunks")
        self._rows: list[tuple] = []
        self._seq = 0
        self._workers: dict[str, dict] | None = None
        self._held: dict[str, dict[str, tuple]] = {}
        if self.control.get(f"producer-{rank}") is not None:
            raise ValueError(f"rank {rank} has joined before")
        self.control.put(f"producer-{rank}", {n: [s.global_shape, s.chunk_shape, s.chunk_position] for n, s in self.specs.items()})
        if wait_for_go:
            wait_until(lambda: self.control.get("analysis") is not None, timeout, "the analysis didn't get ready")

    def workers(self, refresh: bool = False) -> dict[str, dict]:
        """The analysis's workers; one nameless worker before it is there."""
        if refresh or not self._workers:
            self._workers = (self.control.get("analysis") or {}).get("workers")
        return dict(self._workers or {"": {}})

    def send(self, array_name: str, chunk: np.ndarray, timestep: int, *, update_workers: bool = False, filter_workers: Callable[[dict], list[str]] | None = None) -> None:
        """Appends a chunk for the worker at place (timestep + rank) modulo their number.

        update_workers asks the analysis for its workers again; filter_workers gets a copy of them and returns
        the names among which this chunk's worker is chosen.
        """
        if array_name not in self.specs:
            raise ValueError(f"array {array_name} wasn't declared")
        spec = self.specs[array_name]
        known = self.workers(update_workers)
        chosen = list(known)
        if filter_workers is not None:
            chosen = filter_workers(dict(known))
            if not isinstance(chosen, list) or not chosen or not all(isinstance(x, str) for x in chosen):
                raise TypeError("filter_workers returns a list of strings that isn't empty")
            if unknown := set(chosen) - set(known):
                raise ValueError(f"no such workers: {', '.join(sorted(unknown))}")
        if tuple(np.shape(chunk)) != spec.chunk_shape:
            raise ValueError(f"array {array_name}: a chunk of {np.shape(chunk)} instead of {spec.chunk_shape}")
        self._seq = max(self._seq + 1, time.time_ns())
        worker = sorted(chosen)[(timestep + self.rank) % len(chosen)]
        self._rows.append((array_name, timestep, self.rank, self._seq, spec.chunk_position, np.array(chunk), worker))
        if len(self._rows) >= self.buffer:
            self.flush()

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        self.writer.append(rows)

    def get(self, key: str, timestep: int | None = None, default=None):
        """Feedback of a key: all held (timestep, value) pairs, or the first of a timestep, or the default."""
        folder, held = Folder(self.root, f"feedback/{key.encode().hex()}"), self._held.setdefault(key, {})
        names = folder.names()
        fresh = {n: folder.get(n) for n in names if n not in held}
        self._held[key] = held = {n: held[n] if n in held else tuple(fresh[n]) for n in names if n in held or fresh[n] is not None}
        if timestep is None:
            return list(held.values())
        return next((v for t, v in held.values() if t == timestep), default)

    def close(self, timestep: int | None = None) -> None:
        """Flushes and reports this rank done; further calls do nothing."""
        if not self.closed:
            self.closed = True
            self.flush()
            self.control.put(f"left-{self.rank}", timestep)
