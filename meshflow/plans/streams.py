"""Queries that run as streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshflow.model import ArraySpec, Window
from meshflow.plans.registry import EV, _cte, query
from meshflow.plans.tables import SIX_HOURS, arrays_of_events, chunks_of_events, read, timestep_of
from meshflow.streaming.firing import SUBSCRIPTIONS, fire, with_state_store
from meshflow.streaming.run import run_once, shared_folder
from meshflow.streaming.session import Analysis, Session


@query("""WITH ev AS (SELECT event_type AS array_name, (CAST(epoch(ts) AS BIGINT) - 1704067200) // 21600 AS timestep, user_id % 4 AS rank, value FROM events)
SELECT array_name, timestep, count(*) AS n_cells, round(sum(value), 4) AS total FROM ev GROUP BY ALL HAVING count(DISTINCT rank) = 4""")
def stream_assemble(spark, sf_dir):
    """A streaming aggregation; a bit for each rank, from -3 to 3, tells when a timestep is complete."""
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    cells = stream.select(F.col("event_type").alias("array_name"), timestep_of("ts", SIX_HOURS).alias("timestep"), F.expr("shiftleft(1, cast(user_id % 4 as int) + 3)").alias("bit"), "value")
    per = cells.groupBy("array_name", "timestep").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"), F.bit_or("bit").alias("bits"))
    return run_once(per.where("bit_count(bits) = 4").select("array_name", "timestep", "n_cells", F.round("total", 4).alias("total")), "complete")


def _arrivals(spark, sf_dir, names) -> DataFrame:
    """Complete arrays as a stream, in lock-step order."""
    arrays = arrays_of_events(spark, sf_dir).where(F.col("array_name").isin(*names))
    ord_ = F.array_position(F.array(*map(F.lit, names)), F.col("array_name"))
    folder = f"{shared_folder(spark)}/arrivals_{uuid.uuid4().hex}"
    arrays.select("array_name", "timestep", (F.col("timestep") * 10 + ord_).alias("seq")).write.parquet(folder)
    return with_state_store(spark).readStream.schema("array_name string, timestep bigint, seq bigint").parquet(folder)


def _fired(spark, sf_dir, names, size, when) -> DataFrame:
    subscriptions = spark.createDataFrame([("cb", i, n, size, when) for i, n in enumerate(names)], SUBSCRIPTIONS)
    return run_once(fire(_arrivals(spark, sf_dir, names), subscriptions)).where("kind = 'fire'").select("seq", "array_name", "timestep", "windows")


_LISTS = """, w AS (SELECT array_name, timestep, list(CAST(timestep AS VARCHAR)) OVER (PARTITION BY array_name ORDER BY timestep ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l FROM arrays)"""


@query(EV + _LISTS + " SELECT timestep * 10 + 1 AS seq, array_name, timestep, array_to_string(l, ',') AS windows FROM w WHERE array_name = 'click'")
def stream_window3(spark, sf_dir):
    return _fired(spark, sf_dir, ["click"], 3, "AND")


@query(EV + _LISTS + """ SELECT b.timestep * 10 + 2 AS seq, b.array_name, b.timestep, array_to_string(a.l, ',') || '|' || array_to_string(b.l, ',') AS windows
FROM w a JOIN w b ON a.timestep = b.timestep AND a.array_name = 'click' AND b.array_name = 'view'""")
def stream_and2(spark, sf_dir):
    return _fired(spark, sf_dir, ["click", "view"], 3, "AND")


@query(EV + """, a AS (SELECT *, CASE array_name WHEN 'click' THEN 1 ELSE 2 END AS ord FROM arrays WHERE array_name IN ('click', 'view'))
SELECT timestep * 10 + ord AS seq, array_name, timestep,
coalesce(CAST(max(CASE WHEN ord = 1 THEN timestep END) OVER o AS VARCHAR), '') || '|' || coalesce(CAST(max(CASE WHEN ord = 2 THEN timestep END) OVER o AS VARCHAR), '') AS windows
FROM a WINDOW o AS (ORDER BY timestep, ord ROWS UNBOUNDED PRECEDING)""")
def stream_or2(spark, sf_dir):
    return _fired(spark, sf_dir, ["click", "view"], 1, "OR")


WEEK = 7 * 86400


def _played(spark, sf_dir) -> Session:
    """A session in which four ranks have sent weekly chunks of one array, of one cell each, to workers a and c of three."""
    session = Session(spark, f"{shared_folder(spark)}/session_{uuid.uuid4().hex}", 4)
    producers = [session.producer(r, {"click": ArraySpec((2, 2), (1, 1), (r // 2, r % 2))}, wait_for_go=False) for r in range(4)]
    session.announce({"a": {}, "b": {}, "c": {}})
    chunks = chunks_of_events(spark, sf_dir, WEEK).where("array_name = 'click'").select("timestep", "rank", "s")
    for r in chunks.orderBy("timestep", "rank").toLocalIterator():
        producers[r["rank"]].send("click", np.array([[r.s]]), r.timestep, filter_workers=lambda w: [n for n in w if n != "b"])
    for p in producers:
        p.close()
    return session


@query(_cte(WEEK) + """, w AS (SELECT timestep, round(sum(total) OVER (ORDER BY timestep ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS window_sum FROM arrays WHERE array_name = 'click')
SELECT 'sum' AS key, timestep, window_sum AS value FROM w""")
def session_feedback(spark, sf_dir):
    """Producers, a callback on windows of two, and what it feeds back to the producers."""
    session = _played(spark, sf_dir)
    session.join()
    analysis = Analysis(session)
    analysis.register_callback(lambda x: analysis.set("sum", round(sum(a.sum() for a in x), 4), x[-1].t), Window("click", 2))
    analysis.execute_callbacks()
    rows = session.feedback().select("key", "timestep", F.col("value").cast("double").alias("value"))
    analysis.close()
    return rows


@query(_cte(WEEK) + """, c AS (SELECT timestep, rank FROM chunks WHERE array_name = 'click')
SELECT CASE (timestep + rank) % 2 WHEN 0 THEN 'a' ELSE 'c' END AS worker, rank, count(*) AS n_chunks FROM c GROUP BY ALL""")
def session_workers(spark, sf_dir):
    """Where the filter of workers has placed the chunks."""
    return _played(spark, sf_dir).log.read().groupBy("worker", "rank").agg(F.count("*").alias("n_chunks"))
