"""Producers, callbacks and feedback around one chunk log.

A Session is the analysis's side of the rendezvous: producers, in this process or any other, declare arrays
and send chunks through the shared folder; the analysis registers callbacks, and execute_callbacks() runs
them on complete timesteps in the order in which these were completed, until every producer has closed. The
log is read as a stream, each chunk once, of which only metadata comes to the driver; it holds what is
incomplete. Callbacks get one list of ArrayAt for each array of their registration; the cells stay in Spark,
persisted while a window holds them, until a callback asks for them.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflow.functions import arrays as A
from meshflow.model import FEEDBACK, ArraySpec, Window
from meshflow.operators import assemble
from meshflow.sources.chunk_log import ChunkLog
from meshflow.streaming.control import Folder, wait_until
from meshflow.streaming.machine import TriggerMachine
from meshflow.streaming.producer import Producer

log = logging.getLogger(__name__)
_sessions: dict[str, Session] = {}
_lock = threading.Lock()


def get_session(where: SparkSession | str) -> SparkSession:
    """A SparkSession as it is, or one for a master URL or for a file with lines `key value`; else ValueError."""
    if isinstance(where, SparkSession):
        return where
    if isinstance(where, str):
        if where.startswith(("local", "spark://", "yarn", "k8s://")):
            return SparkSession.builder.master(where).getOrCreate()
        try:
            with open(where, encoding="utf-8") as f:
                conf = dict(line.split(None, 1) for line in f.read().splitlines() if line.strip() and not line.startswith("#"))
        except (OSError, ValueError) as e:
            raise ValueError(f"no master URL and no configuration file: {where}") from e
        return SparkSession.builder.config(map=conf).getOrCreate()
    raise ValueError(f"neither a session nor an address: {where!r}")


def open_session(spark: SparkSession | str, root: str, n_producers: int = 1) -> Session:
    """The one session of a root folder, made at first use."""
    with _lock:
        if root not in _sessions:
            _sessions[root] = Session(get_session(spark), root, n_producers)
        return _sessions[root]


@dataclass(eq=False)
class ArrayAt:
    """One array at one timestep, as it was completed: a resent timestep is another one."""

    log: ChunkLog
    name: str
    t: int
    spec: ArraySpec
    dtype: str
    sent: dict[int, int]  # rank -> seq of its chunk
    _pinned: DataFrame | None = field(default=None, repr=False)

    @property
    def timestep(self) -> int:
        return self.t

    @property
    def shape(self) -> tuple[int, ...]:
        return self.spec.global_shape

    @property
    def chunksize(self) -> tuple[int, ...]:
        return self.spec.chunk_shape

    @property
    def npartitions(self) -> int:
        return self.spec.n_blocks

    @property
    def column(self) -> str:
        return "data_long" if np.dtype(self.dtype).kind in "iub" else "data"

    def chunks(self) -> DataFrame:
        """Its chunks with block_index; kept by the executors from first use on until no window holds the array."""
        if self._pinned is None:
            own = self.log.of(self.name, self.t).where(F.col("seq").between(min(self.sent.values()), max(self.sent.values())))
            own = own.where(F.create_map(*(F.lit(x) for pair in self.sent.items() for x in pair))[F.col("rank")] == F.col("seq"))
            self._pinned = assemble.block_index(own).persist(StorageLevel.MEMORY_AND_DISK)
        return self._pinned

    def release(self) -> None:
        if self._pinned is not None:
            self._pinned.unpersist()
            self._pinned = None

    def cells(self) -> DataFrame:
        """i0, i1, ..., value of each cell."""
        rows = self.chunks().select("block_index", F.col(self.column).alias("data"))
        return assemble.cells(rows, self.spec.chunk_shape, self.spec.grid)

    def sum(self) -> float:
        if self.column == "data_long":
            return self.chunks().select(F.aggregate("data_long", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("s")).agg(F.sum("s")).first()[0]
        return A.reduce_all(self.chunks()).first()["total"]

    def map_blocks(self, fn: Callable[[np.ndarray], np.ndarray], to: str | None = None) -> DataFrame:
        """Chunks with fn of each; cells stay of their type unless `to` is given."""
        return A.map_blocks(self.chunks(), fn, self.spec.chunk_shape, self.column, to)

    def compute(self) -> np.ndarray:
        """On the driver, as numpy."""
        return A.to_ndarray(self.cells(), self.shape, dtype=self.dtype)


class Session:
    def __init__(self, spark: SparkSession, root: str, n_producers: int = 1, max_feedback: int = 1024):
        self.spark, self.root, self.n_producers, self.max_feedback = spark, root, n_producers, max_feedback
        self.log, self.control = ChunkLog(spark, f"{root}/chunks"), Folder(root, "control")
        self.errors: list[tuple[str, str, int | None, str]] = []
        self.specs: dict[str, ArraySpec] = {}
        self.ranks: dict[str, set[int]] = {}
        self._known: set[str] = set()
        self._first_rank: dict[str, int] = {}
        self._feedback = 0

    def producer(self, rank: int, specs: Mapping[str, ArraySpec | Mapping], **options) -> Producer:
        """A producer in this process."""
        return Producer(self.root, rank, specs, **options)

    def analysis(self, timeout: float = 10, wait_for_producers: bool = True) -> Analysis:
        self.announce()
        if wait_for_producers:
            wait_until(lambda: len(self.control.names("producer-")) >= self.n_producers, timeout, "not all producers joined")
        self.join()
        return Analysis(self)

    def announce(self, workers: Mapping[str, Mapping] | None = None) -> None:
        """Tells producers that the analysis is ready, and the workers among which they place chunks."""
        self.control.put("analysis", {"workers": workers or self.partitions()})

    def join(self) -> None:
        """Takes in the declarations of producers that have come; the smallest rank's holds."""
        for name in self.control.names("producer-"):
            if name in self._known:
                continue
            self._known.add(name)
            rank = int(name.removeprefix("producer-"))
            for array, shapes in self.control.get(name).items():
                self.ranks.setdefault(array, set()).add(rank)
                if rank <= self._first_rank.get(array, rank):
                    self._first_rank[array], self.specs[array] = rank, ArraySpec(*map(tuple, shapes))

    def partitions(self) -> dict[str, dict]:
        return {f"partition-{i}": {} for i in range(self.spark.sparkContext.defaultParallelism)}

    def done(self) -> bool:
        return len(self.control.names("left-")) >= self.n_producers

    @property
    def final_timestep(self) -> int | None:
        """The largest timestep that a producer has closed with."""
        said = [self.control.get(n) for n in self.control.names("left-")]
        return max((t for t in said if t is not None), default=None)

    def set(self, key: str, value, timestep: int) -> None:
        """Feedback for the producers; of a key the last max_feedback values are held."""
        folder = Folder(self.root, f"feedback/{key.encode().hex()}")
        self._feedback = max(self._feedback + 1, time.time_ns())
        folder.put(f"{self._feedback:020}", [timestep, value])
        for name in folder.names()[: -self.max_feedback]:
            folder.drop(name)

    def feedback(self) -> DataFrame:
        """The feedback that is held, as rows of FEEDBACK; value is JSON."""
        root = Folder(self.root, "feedback")
        root.fs.create_dir(root.path)
        path = F.col("_metadata.file_path")
        key = F.unhex(F.regexp_extract(path, "/([0-9a-f]*)/[0-9]+[.]json$", 1)).cast("string")
        rows = self.spark.read.schema("line string").option("recursiveFileLookup", "true").text(f"{self.root}/feedback", wholetext=True)
        seq = F.regexp_extract(path, "/([0-9]+)[.]json$", 1).cast("bigint")
        rows = rows.select(key.alias("key"), seq.alias("seq"), F.get_json_object("line", "$[0]").cast("bigint").alias("timestep"), F.get_json_object("line", "$[1]").alias("value"))
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in FEEDBACK.fields))


def _log_error(e: BaseException) -> None:
    log.error("callback failed: %s", e)


class Analysis:
    def __init__(self, session: Session):
        self.session = session
        self._callbacks: dict[str, tuple[Callable, TriggerMachine, Callable | None]] = {}
        self._next = 0
        self._pending: dict[tuple[str, int], list[dict[int, tuple[int, str]]]] = {}
        self._held: set[ArrayAt] = set()
        self._progress = f"{session.root}/progress/{uuid.uuid4().hex}"

    def register(self, *arrays: str | Window, exception_handler: Callable | None = _log_error, when: str = "AND"):
        """Decorator of register_callback()."""
        return lambda callback: self.register_callback(callback, *arrays, exception_handler=exception_handler, when=when)

    def register_callback(self, callback: Callable, *arrays: str | Window, exception_handler: Callable | None = _log_error, when: str = "AND") -> Callable:
        if not arrays:
            raise TypeError("a callback needs an array")
        for a in arrays:
            if not isinstance(a, str | Window):
                raise TypeError(f"neither a name nor a Window: {a!r}")
        windows = [Window(a) if isinstance(a, str) else a for a in arrays]
        if when not in ("AND", "OR"):
            raise ValueError(f"when is AND or OR, not {when}")
        self.session.join()
        for w in windows:
            if w.name not in self.session.specs:
                raise ValueError(f"no producer declared the array {w.name}")
            if w.size < 1:
                raise ValueError("a window holds at least one array")
        callback_id = f"callback_{self._next}"
        self._next += 1
        self._callbacks[callback_id] = (callback, TriggerMachine([(w.name, w.size) for w in windows], when), exception_handler)
        try:
            callback.callback_id = callback_id
        except AttributeError:  # a bound method
            log.debug("%s has no attribute for its id", callback)
        return callback

    def unregister_callback(self, which: str | Callable) -> None:
        """By id or function; an unknown one is left alone."""
        own = getattr(which, "callback_id", None)
        for k in [k for k, (f, _, _) in self._callbacks.items() if k in (which, own) or f == which]:
            del self._callbacks[k]

    def set(self, key: str, value, timestep: int) -> None:
        """Feedback that producers get()."""
        self.session.set(key, value, timestep)

    def subscriptions(self) -> list[tuple[str, int, str, int, str]]:
        return [(k, i, n, m.size[n], m.when) for k, (_, m, _) in self._callbacks.items() for i, n in enumerate(m.order)]

    def _writer(self):
        chunks = self.session.log.stream().select("array_name", "timestep", "rank", "seq", "dtype")
        return chunks.writeStream.foreachBatch(self._batch).option("checkpointLocation", self._progress)

    def execute_callbacks(self, poll: float = 0.2) -> None:
        """Runs callbacks as chunks come, until all producers have closed and all complete timesteps are handled."""
        query = self._writer().trigger(processingTime=f"{int(poll * 1000)} milliseconds").start()
        try:
            while not self.session.done() and query.isActive:
                query.awaitTermination(poll)
            if query.isActive:
                query.processAllAvailable()
            elif query.exception():
                raise query.exception()
        finally:
            query.stop()

    def drain(self) -> None:
        """Handles what has come since the last time."""
        self._writer().trigger(availableNow=True).start().awaitTermination()

    def _batch(self, chunks: DataFrame, number: int) -> None:
        """Takes in a micro-batch's metadata, and handles what it completes."""
        self.session.join()
        for r in sorted(chunks.collect(), key=lambda r: r.seq):
            open_ = self._pending.setdefault((r.array_name, r.timestep), [])
            # the first occurrence of the timestep that lacks this rank's chunk
            occurrence = next((o for o in open_ if r["rank"] not in o), None)
            if occurrence is None:
                open_.append(occurrence := {})
            occurrence[r["rank"]] = (r.seq, r.dtype)
            if set(occurrence) >= self.session.ranks.get(r.array_name, {None}):
                open_.remove(occurrence)
                if not open_:
                    del self._pending[r.array_name, r.timestep]
                self._complete(r.array_name, r.timestep, occurrence)

    def _complete(self, name: str, t: int, chunks: dict[int, tuple[int, str]]) -> None:
        spec, kinds = self.session.specs[name], sorted({k for _, k in chunks.values()})
        if len(chunks) != spec.n_blocks or len(kinds) > 1:
            self.session.errors.append(("tile", name, t, f"{len(chunks)} chunks of {'/'.join(kinds)} for a grid of {spec.grid}"))
            log.error("array %s at %s can't be tiled", name, t)
            return
        array = ArrayAt(self.session.log, name, t, spec, kinds[0], {rank: seq for rank, (seq, _) in chunks.items()})
        self._held.add(array)
        self._arrive(array)
        windows = {a for _, m, _ in self._callbacks.values() for w in m.window.values() for a in w}
        for old in self._held - windows:
            old.release()
        self._held &= windows

    def _arrive(self, array: ArrayAt) -> None:
        for callback_id, (callback, machine, handler) in list(self._callbacks.items()):
            if array.name not in machine.size or callback_id not in self._callbacks:
                continue
            said = machine.arrive(array.name, array.t, array)
            if said is None:
                continue
            try:
                if said[0] == "late":
                    raise ValueError(said[1])
                callback(*said[1])
            except Exception as e:
                self.session.errors.append((said[0], array.name, array.t, str(e)))
                if handler is not None:
                    try:
                        handler(e)
                    except BaseException:
                        log.exception("the handler of %s failed; it is unregistered", callback_id)
                        self._callbacks.pop(callback_id, None)

    def close(self) -> None:
        """Forgets callbacks, windows and the rendezvous; the log stays."""
        self._callbacks.clear()
        for array in self._held:
            array.release()
        self._held.clear()
        self.session.control.clear()
        Folder(self._progress).clear()
        with _lock:
            _sessions.pop(self.session.root, None)


def missing_report(session: Session) -> DataFrame:
    """Declared chunks that haven't come, for timesteps that have begun."""
    rows: Sequence[tuple[str, int]] = [(n, r) for n, ranks in session.ranks.items() for r in sorted(ranks)]
    return assemble.missing(session.log.read(), session.spark.createDataFrame(rows, "array_name string, rank int"))
