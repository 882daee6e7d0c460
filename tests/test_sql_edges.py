"""Queries over events at the edges of timesteps, and over odd rows, equal DuckDB's results."""

import duckdb
import pytest
from test_queries import tidy

from meshflow.plans import registry, streams  # noqa: F401

DAY = "2024-01-01 "


def edges():
    """Events within half a second before a timestep, which belong to it, and before 2024; (ts, user_id, event_type, value)."""
    rows = [(f"{DAY}{6 * t + 1:02}:{n:02}:00", r, a, 1.5 * t + r + n) for a in ("click", "view", "purchase") for t in range(3) for r in range(4) for n in range(2)]
    rows += [(f"{DAY}07:30:00", 0, a, 2.25) for a in ("click", "view")]  # the largest chunk, before the next row
    rows += [(f"{DAY}05:59:59.7", 0, a, 10.5) for a in ("click", "view")]
    rows += [(f"{DAY}11:59:59.5", 1, a, 3.75) for a in ("click", "view", "purchase")]  # a half, to the even second
    rows += [(f"{DAY}05:59:58.5", 2, "click", 4.0), (f"{DAY}17:59:59.6", 1, "click", 7.0)]  # the last alone in its timestep
    rows += [("2023-12-31 23:00:00", r, "click", 0.5) for r in range(4)] + [("2023-12-31 12:00:00.4", r, "view", 0.25) for r in range(4)]
    return rows


def odd():
    """Users that are null or negative, and events without a time, a type or a value."""
    rows = [(f"{DAY}{6 * t + 1:02}:00:00", u, a, t + 0.5 * (u or 9)) for a in ("click", "view", "signup") for t in range(3) for u in (None, -3, -2, -1, 0, 1, 2, 3)]
    rows += [(f"{DAY}19:00:00", u, "click", 2.5 - (u or 7)) for u in (None, -1, 1, 2)] + [(f"{DAY}19:00:00", u, "view", 2.5 * u) for u in (-1, 0, 1, -2)]
    rows += [(None, u, a, 1.25 + u) for a in ("click", "view") for u in range(4)]
    rows += [(f"{DAY}13:00:00", u, None, 5.0) for u in (None, 1, 1, 1)] + [(f"{DAY}13:00:00", u, "purchase", None) for u in range(4)]
    return rows + 2 * [(f"{DAY}01:30:00", None, "click", 3.5)]


def folder(tmp_path_factory, rows):
    path = tmp_path_factory.mktemp("events")
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, '{}')", [(i, *row) for i, row in enumerate(rows)])
    con.execute(f"COPY events TO '{path}/events.parquet'")
    return str(path), con


@pytest.fixture(scope="module")
def at_edges(tmp_path_factory):
    return folder(tmp_path_factory, edges())


@pytest.fixture(scope="module")
def with_odd_rows(tmp_path_factory):
    return folder(tmp_path_factory, odd())


def equal(spark, name, table):
    path, con = table
    assert tidy(registry.QUERIES[name](spark, path).toPandas()) == tidy(con.execute(registry.ORACLE_SQL[name]).df())


EDGES = [
    "array_assemble",
    "block_layout",
    "late_rejects",
    "global_cells",
    "temporal_diff",
    "stream_assemble",
    "window_size1",
    "duplicate_timesteps",
    "trigger_or2",
    "missing_chunks",
    "tile_errors",
    "incomplete_timesteps",
    "participants_only",
    "catalog_merge",
]


@pytest.mark.parametrize("name", EDGES)
def test_edges(spark, at_edges, name):
    equal(spark, name, at_edges)


ODD = [
    "block_layout",
    "global_cells",
    "temporal_diff",
    "stream_assemble",
    "trigger_or2",
    "participants_only",
]


@pytest.mark.parametrize("name", ODD)
def test_odd_rows(spark, with_odd_rows, name):
    equal(spark, name, with_odd_rows)
