"""Firing rule, sessions, callbacks, error policy and the stateful operator."""

import os
import random
import subprocess
import sys
import threading
import time

import numpy as np
import pytest

from meshflow.model import Window
from meshflow.streaming.firing import SUBSCRIPTIONS, fire, with_state_store
from meshflow.streaming.machine import TriggerMachine
from meshflow.streaming.producer import Producer
from meshflow.streaming.run import run_once
from meshflow.streaming.session import Session, get_session, missing_report, open_session

GRID = [(0, 0), (0, 1), (1, 0), (1, 1)]


def spec(at=(0,), shape=(8,), chunk=(8,)):
    return {"global_shape": shape, "chunk_shape": chunk, "chunk_position": at}


def played(arrays, when, sequence):
    m = TriggerMachine(arrays, when)
    return [m.arrive(n, t) for n, t in sequence]


def test_and_in_lock_step_and_skewed():
    fires = lambda s: [x[1] for x in played([("x", 1), ("y", 1)], "AND", s) if x and x[0] == "fire"]
    assert fires([("x", 1), ("y", 1), ("x", 2), ("y", 2)]) == [[[1], [1]], [[2], [2]]]
    assert fires([("x", 1), ("x", 2), ("y", 1), ("y", 2)]) == [[[2], [2]]]
    assert fires([("x", t) for t in range(1, 6)] + [("y", 5)]) == [[[5], [5]]]
    wide = played([("x", 3), ("y", 1)], "AND", [("x", t) for t in range(1, 6)] + [("y", 5)])
    assert wide[-1] == ("fire", [[3, 4, 5], [5]])


def test_or_late_and_equal():
    got = played([("x", 2), ("y", 1)], "OR", [("x", 1), ("y", 1), ("x", 2), ("x", 2), ("x", 1)])
    assert got[:4] == [("fire", [[1], []]), ("fire", [[1], [1]]), ("fire", [[1, 2], [1]]), ("fire", [[2, 2], [1]])]
    assert got[4][0] == "late"


def test_repeated_array_and_dump():
    m = TriggerMachine([("x", 3), ("x", 2)], "AND")
    m.arrive("x", 1)
    m = TriggerMachine.load(m.dump())
    m.arrive("x", 2)
    assert m.arrive("x", 3) == ("fire", [[2, 3], [2, 3]])
    with pytest.raises(ValueError):
        TriggerMachine([("x", 1)], "XOR")


def test_stateful_operator_equals_machine(spark, tmp_path):
    rng = random.Random(5)
    arrivals = [(rng.choice("xyz"), rng.randint(0, 4) + k // 6, k) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(arrivals[k * 20 : k * 20 + 20], "array_name string, timestep bigint, seq bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    subs = [("a", 0, "x", 2, "AND"), ("a", 1, "y", 1, "AND"), ("b", 0, "y", 3, "OR"), ("b", 1, "z", 1, "OR")]
    stream = with_state_store(spark).readStream.schema("array_name string, timestep bigint, seq bigint").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = run_once(fire(stream, spark.createDataFrame(subs, SUBSCRIPTIONS)), folder=str(tmp_path / "out")).orderBy("callback_id", "seq").collect()
    want = []
    for cb, arrays, when in (("a", [("x", 2), ("y", 1)], "AND"), ("b", [("y", 3), ("z", 1)], "OR")):
        m = TriggerMachine(arrays, when)
        for n, t, s in arrivals:
            said = m.arrive(n, t) if n in m.size else None
            if said:
                want.append((cb, s, said[0], n, t, "|".join(",".join(map(str, w)) for w in said[1]) if said[0] == "fire" else said[1]))
    assert [tuple(r) for r in got] == want


def test_session_end_to_end(spark, tmp_path):
    session = Session(spark, str(tmp_path), 4)
    a = np.random.default_rng(42).random((3, 8, 8))
    producers = [session.producer(r, {"t": spec(at, (8, 8), (4, 4))}, wait_for_go=False) for r, at in enumerate(GRID)]
    analysis = session.analysis()
    seen, first = [], []

    @analysis.register(Window("t", 2))
    def window_of_two(t):
        seen.append(([x.t for x in t], round(t[-1].sum(), 9), t[-1].npartitions))
        analysis.set("ack", t[-1].t, t[-1].t)

    analysis.register_callback(lambda t: first.append(t[0].compute()), "t")
    for t in range(3):
        for p in reversed(producers):
            p.send("t", a[t][tuple(slice(4 * i, 4 * i + 4) for i in GRID[p.rank])], t)
    for p in producers:
        p.close(2)
        p.close(2)
    analysis.execute_callbacks()
    assert seen == [([0], round(a[0].sum(), 9), 4), ([0, 1], round(a[1].sum(), 9), 4), ([1, 2], round(a[2].sum(), 9), 4)]
    assert all(np.array_equal(x, y) for x, y in zip(first, a, strict=True))
    assert producers[0].get("ack") == [(0, 0), (1, 1), (2, 2)] and producers[3].get("ack", 1) == 1 and producers[1].get("ack", 9, "no") == "no"
    assert session.final_timestep == 2 and not session.errors


def test_errors_and_participation(spark, tmp_path):
    session = Session(spark, str(tmp_path), 2)
    p0 = session.producer(0, {"shared": spec((0,), (16,), (8,)), "solo": spec()}, wait_for_go=False)
    p1 = session.producer(1, {"shared": spec((1,), (16,), (8,))}, wait_for_go=False)
    analysis = session.analysis()
    caught, calls = [], []

    def failing(x):
        calls.append(x[0].t)
        raise RuntimeError("no")

    def bad_handler(e):
        caught.append(str(e))
        raise SystemExit

    analysis.register_callback(failing, "solo", exception_handler=bad_handler)
    analysis.register_callback(lambda x: calls.append("kept") or 1 / 0, "solo", exception_handler=None)
    for bad, error in (((), TypeError), ((3,), TypeError), (("nothing",), ValueError)):
        with pytest.raises(error):
            analysis.register_callback(failing, *bad)
    with pytest.raises(ValueError):
        analysis.register_callback(failing, "solo", when="XOR")
    with pytest.raises(ValueError):
        p1.send("solo", np.ones(8), 0)
    with pytest.raises(TypeError):
        p0.send("solo", np.ones(8), 0, filter_workers=lambda w: [])
    with pytest.raises(ValueError):
        p0.send("solo", np.ones(3), 0)
    p0.send("solo", np.ones(8), 0, filter_workers=lambda w: list(w)[:1])
    p0.send("solo", np.arange(8), 1)
    p0.send("shared", np.ones(8), 0)
    p0.close()
    p1.close()
    analysis.execute_callbacks()
    assert caught == ["no"] and calls == [0, "kept", "kept"]
    assert [(r.array_name, r.timestep, r["rank"]) for r in missing_report(session).collect()] == [("shared", 0, 1)]
    analysis.unregister_callback("unknown")
    analysis.close()


def test_connections(spark, tmp_path):
    assert get_session(spark) is spark
    for bad in (3, str(tmp_path / "missing")):
        with pytest.raises(ValueError):
            get_session(bad)
    assert open_session(spark, str(tmp_path)) is open_session(spark, str(tmp_path))


def test_resent_timesteps_are_occurrences(spark, tmp_path):
    session = Session(spark, str(tmp_path), 2)
    producers = [session.producer(r, {"x": spec((r,), (4,), (2,))}, wait_for_go=False, buffer=1) for r in range(2)]
    analysis = session.analysis()
    fired = []
    analysis.register_callback(lambda x: fired.append([a.compute().tolist() for a in x]), Window("x", 2))

    def both(value, ranks=(0, 1)):
        for r in ranks:
            producers[r].send("x", np.full(2, value), 1)

    both(1.0)
    analysis.drain()
    both(2.0, [0])
    analysis.drain()
    assert fired == [[[1.0] * 4]]
    both(2.0, [1])
    both(3.0)
    for p in producers:
        p.close()
    analysis.execute_callbacks()
    assert fired == [[[1.0] * 4], [[1.0] * 4, [2.0] * 4], [[2.0] * 4, [3.0] * 4]]
    assert not analysis._pending


@pytest.mark.parametrize("dtype", ["int64", "int32", "uint8", "float32", "float64"])
def test_cells_keep_their_type(spark, tmp_path, dtype):
    session = Session(spark, str(tmp_path), 1)
    x = np.array([[1_700_000_000_123_456_789 if dtype == "int64" else 7, 2], [3, 4]]).astype(dtype)
    p = session.producer(0, {"x": spec((0, 0), (2, 2), (2, 2))}, wait_for_go=False)
    analysis = session.analysis()
    seen = []

    def look(a):
        doubled = a[0].map_blocks(lambda b: b * 2).first()[a[0].column]
        halves = a[0].map_blocks(lambda b: b / 4, "double").first()[a[0].column]
        seen.append((a[0].compute(), a[0].sum(), doubled, halves))

    analysis.register_callback(look, "x")
    p.send("x", x, 0)
    p.close()
    analysis.execute_callbacks()
    assert not session.errors
    got, total, doubled, halves = seen[0]
    assert got.dtype == x.dtype and np.array_equal(got, x) and total == x.sum()
    assert doubled == (x.astype(float if x.dtype.kind == "f" else "int64").ravel() * 2).tolist() and halves == (x.ravel() / 4).tolist()


PRODUCER = """
import sys, time
import numpy as np
sys.path.insert(0, {repo!r})
from meshflow.streaming.producer import Producer
rank = int(sys.argv[2])
p = Producer(sys.argv[1], rank, {{"x": {{"global_shape": (4, 2), "chunk_shape": (2, 2), "chunk_position": (rank, 0)}}}}, timeout=60)
for t in range(3):
    p.send("x", np.full((2, 2), 10 * t + rank), t)
    p.flush()
until = time.time() + 60
while p.get("total", 2) is None and time.time() < until:
    time.sleep(0.1)
print(p.get("total"))
p.close(2)
"""


def test_producers_in_other_processes(spark, tmp_path):
    session = Session(spark, str(tmp_path), 2)
    code = PRODUCER.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    running = [subprocess.Popen([sys.executable, "-c", code, str(tmp_path), str(r)], stdout=subprocess.PIPE, text=True) for r in range(2)]
    analysis = session.analysis(timeout=60)
    analysis.register_callback(lambda x: analysis.set("total", x[0].sum(), x[0].t), "x")
    analysis.execute_callbacks()
    said = [p.communicate(timeout=60)[0].strip() for p in running]
    assert said == ["[(0, 4), (1, 84), (2, 164)]"] * 2 and session.final_timestep == 2 and not session.errors


@pytest.mark.parametrize("first", ["analysis", "producer"])
def test_handshake_in_both_orders(spark, tmp_path, first):
    session, said = Session(spark, str(tmp_path), 1), []

    def produce():
        p = Producer(str(tmp_path), 0, {"x": spec()})
        said.append("producer went")
        p.close(5)

    other = threading.Thread(target=produce)
    if first == "producer":
        other.start()
        time.sleep(0.3)
        assert not said
        analysis = session.analysis()
    else:
        threading.Timer(0.3, other.start).start()
        analysis = session.analysis()
    analysis.execute_callbacks()
    other.join(10)
    assert said and session.final_timestep == 5 and session.specs["x"].n_blocks == 1


def test_handshake_times_out(spark, tmp_path):
    with pytest.raises(TimeoutError):
        Producer(str(tmp_path), 0, {"x": spec()}, timeout=0.1)
    with pytest.raises(ValueError):
        Producer(str(tmp_path), 0, {"x": spec()}, wait_for_go=False)
    with pytest.raises(TimeoutError):
        Session(spark, str(tmp_path), 2).analysis(timeout=0.1)


def test_workers_are_chosen_refreshed_and_filtered(spark, tmp_path):
    session = Session(spark, str(tmp_path), 1)
    p = session.producer(1, {"x": spec()}, wait_for_go=False)
    session.announce({n: {"rack": n[0]} for n in ("b1", "a1", "a2")})
    session.join()
    for t in range(3):
        p.send("x", np.ones(8), t)
    p.send("x", np.ones(8), 3, filter_workers=lambda w: [n for n in w if w[n]["rack"] == "a"])
    session.announce({"c1": {}})
    p.send("x", np.ones(8), 4)
    p.send("x", np.ones(8), 5, update_workers=True)
    with pytest.raises(ValueError):
        p.send("x", np.ones(8), 6, filter_workers=lambda w: ["gone"])
    p.close()
    got = [r.worker for r in session.log.read().orderBy("timestep").collect()]
    assert got == ["a2", "b1", "a1", "a1", "b1", "c1"]


def test_arrays_are_pinned_while_a_window_holds_them(spark, tmp_path):
    session = Session(spark, str(tmp_path), 1)
    p = session.producer(0, {"x": spec()}, wait_for_go=False)
    analysis = session.analysis()
    arrays, cached = [], []

    def look(x):
        x[-1].sum()
        arrays.append(x[-1])
        cached.append([a.chunks().is_cached for a in x])

    analysis.register_callback(look, Window("x", 2))
    for t in range(4):
        p.send("x", np.ones(8), t)
    p.close()
    analysis.execute_callbacks()
    assert cached == [[True], [True, True], [True, True], [True, True]]
    assert [a._pinned is None for a in arrays] == [True, True, False, False]
    analysis.close()
    assert all(a._pinned is None for a in arrays)


def test_feedback_is_bounded(spark, tmp_path):
    session = Session(spark, str(tmp_path), 1, max_feedback=3)
    p = session.producer(0, {"x": spec()}, wait_for_go=False)
    analysis = session.analysis()
    for t in range(5):
        analysis.set("a/b", np.arange(t), t)
        assert p.get("a/b", t) == list(range(t))
    assert p.get("a/b") == [(2, [0, 1]), (3, [0, 1, 2]), (4, [0, 1, 2, 3])] and p.get("other") == []
    with pytest.raises(TypeError):
        analysis.set("a", object(), 1)


def test_names_of_any_kind(spark, tmp_path):
    session = Session(spark, str(tmp_path), 1)
    names = ["a/b=c", "50 %+é", "3"]
    p = session.producer(0, {n: spec() for n in names}, wait_for_go=False)
    analysis = session.analysis()
    seen = []
    for n in names:
        analysis.register_callback(lambda x: seen.append((x[0].name, x[0].sum())), n)
    for k, n in enumerate(names):
        p.send(n, np.full(8, k), 0)
    p.close()
    analysis.execute_callbacks()
    assert sorted(seen) == sorted((n, 8 * k) for k, n in enumerate(names)) and not session.errors
