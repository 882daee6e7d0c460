"""Queries of the array engine and the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflow.functions import arrays as A
from meshflow.functions import grid
from meshflow.operators import assemble, catalog, feedback, triggers, windows
from meshflow.plans.tables import DAY, GRID, arrays_of_events, cells_of_events, chunks_of_events, matrix, matrix_cells, read

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def registered(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return registered


def _cte(seconds: int = 21600) -> str:
    return f"""WITH ev AS (SELECT event_type AS array_name, (CAST(epoch(ts) AS BIGINT) - 1704067200) // {seconds} AS timestep,
  CAST(user_id % 4 AS INTEGER) AS rank, event_id, value FROM events),
chunks AS (SELECT array_name, timestep, rank, round(sum(value), 4) AS s, count(*) AS n_cells FROM ev GROUP BY ALL),
per AS (SELECT array_name, timestep, round(sum(s), 4) AS total, count(*) AS n_chunks FROM chunks GROUP BY ALL),
arrays AS (SELECT * FROM per WHERE n_chunks = 4)"""


EV = _cte()
W3 = """, w3 AS (SELECT array_name, timestep, count(*) OVER w AS n_in_window, round(sum(total) OVER w, 4) AS window_sum, min(timestep) OVER w AS oldest
 FROM arrays WINDOW w AS (PARTITION BY array_name ORDER BY timestep ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
CELLS = """WITH cells AS (SELECT vec_id AS i0, CAST(unnest(generate_series(1, len(embedding))) - 1 AS INTEGER) AS i1, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def _w3(spark, sf_dir, seconds=21600, size=3):
    arrays = arrays_of_events(spark, sf_dir, seconds)
    out = windows.trailing(arrays, size, n_in_window=F.count("*"), window_sum=F.sum("total"), oldest=F.min("timestep"))
    return out.select("array_name", "timestep", "n_in_window", F.round("window_sum", 4).alias("window_sum"), "oldest")


def _and(frames: dict[str, DataFrame]) -> DataFrame:
    return triggers.fire_and({k: v.select("timestep", "n_in_window", "window_sum") for k, v in frames.items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly, trailing windows of three and AND over daily timesteps."""
    w = _w3(spark, sf_dir, DAY)
    return _and({n: w.where(F.col("array_name") == n) for n in ("click", "view")})


def _and_sql(names, cte=EV + W3) -> str:
    cols = ", ".join(f"{n}.n_in_window AS {n}_n_in_window, {n}.window_sum AS {n}_window_sum" for n in names)
    joins = " ".join(f"JOIN w3 {n} ON {n}.timestep = {names[0]}.timestep AND {n}.array_name = '{n}'" for n in names[1:])
    return f"{cte} SELECT {names[0]}.timestep, {cols} FROM w3 {names[0]} {joins} WHERE {names[0]}.array_name = '{names[0]}'"


@query(_and_sql(["click", "view"], _cte(DAY) + W3))
def flagship_daily(spark, sf_dir):
    return flagship(spark, sf_dir)


# assembly


@query(EV + " SELECT array_name, timestep, n_chunks, total FROM arrays")
def array_assemble(spark, sf_dir):
    return arrays_of_events(spark, sf_dir)


@query(EV + " SELECT array_name, timestep, n_chunks FROM per WHERE n_chunks < 4")
def incomplete_timesteps(spark, sf_dir):
    return assemble.incomplete(assemble.counted(chunks_of_events(spark, sf_dir)), 4)


def _catalog(spark, sf_dir) -> DataFrame:
    """A rank declares the arrays that it ever sends; the declared shape is its largest chunk."""
    return chunks_of_events(spark, sf_dir).groupBy("array_name", "rank").agg(F.max("n_cells").alias("chunk_size"))


DECLARED = ", declared AS (SELECT array_name, rank, max(n_cells) AS chunk_size FROM chunks GROUP BY ALL)"


@query(EV + DECLARED + """ SELECT t.array_name, t.timestep, d.rank FROM (SELECT DISTINCT array_name, timestep FROM chunks) t JOIN declared d USING (array_name)
WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.array_name = t.array_name AND c.timestep = t.timestep AND c.rank = d.rank)""")
def missing_chunks(spark, sf_dir):
    return assemble.missing(chunks_of_events(spark, sf_dir), _catalog(spark, sf_dir))


@query(EV + """ SELECT array_name, timestep, rank, CAST(b AS INTEGER) AS block_index, CAST(b // 2 AS INTEGER) AS g0, CAST(b % 2 AS INTEGER) AS g1 FROM
(SELECT array_name, timestep, rank, row_number() OVER (PARTITION BY array_name, timestep ORDER BY rank // 2, rank % 2, rank) - 1 AS b FROM chunks)""")
def block_layout(spark, sf_dir):
    return assemble.layout(chunks_of_events(spark, sf_dir), GRID).select("array_name", "timestep", "rank", "block_index", "g0", "g1")


@query(EV + " SELECT array_name, timestep, n_chunks, CAST(4 AS BIGINT) AS expected FROM per WHERE n_chunks <> 4")
def tile_errors(spark, sf_dir):
    return assemble.tile_errors(assemble.counted(chunks_of_events(spark, sf_dir)), 4)


@query("""WITH o AS (SELECT l_returnflag AS array_name, CAST(month(l_shipdate) AS BIGINT) AS timestep, CAST(l_suppkey % 4 AS INTEGER) AS rank, l_quantity AS value FROM lineitem),
c AS (SELECT array_name, timestep, rank, count(*) AS n, sum(value) AS s FROM o GROUP BY ALL)
SELECT array_name, timestep, CAST(sum(n) AS BIGINT) AS n_cells, sum(s) AS total, count(*) AS n_chunks FROM c GROUP BY ALL HAVING count(*) = 4""")
def lineitem_assemble(spark, sf_dir):
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("array_name"), F.month("l_shipdate").cast("bigint").alias("timestep"), (F.col("l_suppkey") % 4).cast("int").alias("rank"), F.col("l_quantity").alias("value"))
    chunks = cells.groupBy("array_name", "timestep", "rank").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    per = assemble.counted(chunks, F.sum("n").alias("n_cells"), F.sum("s").alias("total"))
    return assemble.complete(per, catalog.participation(chunks))


@query(EV + """, p AS (SELECT array_name, timestep, rank, s, row_number() OVER (PARTITION BY array_name, timestep ORDER BY rank) - 1 AS b FROM chunks SEMI JOIN arrays USING (array_name, timestep))
SELECT array_name, timestep, CAST(b // 2 AS BIGINT) AS i0, CAST((b % 2) * 2 + k AS BIGINT) AS i1, CASE k WHEN 0 THEN s ELSE -s END AS value FROM p, (SELECT unnest([0, 1]) AS k)""")
def global_cells(spark, sf_dir):
    chunks = chunks_of_events(spark, sf_dir).join(arrays_of_events(spark, sf_dir).select("array_name", "timestep"), ["array_name", "timestep"], "left_semi")
    blocks = assemble.block_index(chunks).select("array_name", "timestep", "block_index", F.array("s", -F.col("s")).alias("data"))
    return assemble.cells(blocks, (1, 2), GRID)


# metadata


@query(EV + DECLARED + " SELECT array_name, min(rank) AS rank, arg_min(chunk_size, rank) AS chunk_size FROM declared GROUP BY array_name")
def catalog_merge(spark, sf_dir):
    return catalog.merge(_catalog(spark, sf_dir))


@query(EV + DECLARED + " SELECT array_name, array_to_string(list_sort(list(DISTINCT rank)), ',') AS ranks, count(DISTINCT rank) AS n_ranks FROM declared GROUP BY array_name")
def participation(spark, sf_dir):
    found = catalog.participation(_catalog(spark, sf_dir))
    return found.withColumn("ranks", F.array_join(F.col("ranks").cast("array<string>"), ","))


@query("""WITH d AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS array_name, CAST(o_orderkey % 4 AS INTEGER) AS rank FROM orders)
SELECT array_name, min(rank) AS rank FROM d GROUP BY array_name HAVING count(*) = 1""")
def single_owner(spark, sf_dir):
    declared = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("array_name"), (F.col("o_orderkey") % 4).cast("int").alias("rank"))
    return catalog.single_owner(declared)


@query(EV + " SELECT array_name, rank, count(*) AS n_chunks FROM chunks WHERE (array_name, rank) IN (SELECT (array_name, rank) FROM chunks GROUP BY array_name, rank HAVING max(n_cells) >= 3) GROUP BY ALL")
def participants_only(spark, sf_dir):
    declared = _catalog(spark, sf_dir).where("chunk_size >= 3")
    return catalog.participants_only(chunks_of_events(spark, sf_dir), declared).groupBy("array_name", "rank").agg(F.count("*").alias("n_chunks"))


# windows


@query(EV + " SELECT array_name, timestep, CAST(1 AS BIGINT) AS n_in_window, total AS window_sum, timestep AS oldest FROM arrays")
def window_size1(spark, sf_dir):
    return _w3(spark, sf_dir, size=1)


@query(EV + W3 + " SELECT * FROM w3")
def window_size3(spark, sf_dir):
    return _w3(spark, sf_dir)


SIZES = {"click": 2, "view": 4}


@query(EV + """, w AS (SELECT array_name, timestep, total, CASE array_name WHEN 'click' THEN 2 ELSE 4 END AS k, row_number() OVER (PARTITION BY array_name ORDER BY timestep) AS r FROM arrays WHERE array_name IN ('click', 'view'))
SELECT a.array_name, a.timestep, count(*) AS n_in_window, round(sum(b.total), 4) AS window_sum FROM w a JOIN w b ON a.array_name = b.array_name AND b.r <= a.r AND b.r > a.r - a.k GROUP BY a.array_name, a.timestep""")
def window_per_array_sizes(spark, sf_dir):
    out = windows.trailing_by_name(arrays_of_events(spark, sf_dir), SIZES, "total")
    return out.select("array_name", "timestep", "n_in_window", F.round("window_sum", 4).alias("window_sum"))


# triggers


@query(_and_sql(["click", "view"]))
def trigger_and2(spark, sf_dir):
    w = _w3(spark, sf_dir)
    return _and({n: w.where(F.col("array_name") == n) for n in ("click", "view")})


@query(_and_sql(["click", "view", "purchase"]))
def trigger_and3(spark, sf_dir):
    w = _w3(spark, sf_dir)
    return _and({n: w.where(F.col("array_name") == n) for n in ("click", "view", "purchase")})


@query(EV + """, sparse AS (SELECT * FROM arrays WHERE array_name = 'click' OR array_name = 'view' AND timestep % 3 = 0)"""
       + W3.replace("FROM arrays", "FROM sparse") + " " + _and_sql(["click", "view"], ""))
def trigger_and_sparse(spark, sf_dir):
    """The second array only exists at every third timestep: its windows reach farther back."""
    arrays = arrays_of_events(spark, sf_dir)
    sparse = arrays.where("array_name = 'click' or array_name = 'view' and timestep % 3 = 0")
    w = windows.trailing(sparse, 3, n_in_window=F.count("*"), window_sum=F.sum("total")).withColumn("window_sum", F.round("window_sum", 4))
    return _and({n: w.where(F.col("array_name") == n) for n in ("click", "view")})


@query(EV + """, a AS (SELECT timestep, array_name, total, CASE array_name WHEN 'click' THEN 1 ELSE 2 END AS ord FROM arrays WHERE array_name IN ('click', 'view'))
SELECT timestep, array_name, last_value(CASE WHEN array_name = 'click' THEN total END IGNORE NULLS) OVER w AS click_total,
last_value(CASE WHEN array_name = 'view' THEN total END IGNORE NULLS) OVER w AS view_total FROM a WINDOW w AS (ORDER BY timestep, ord ROWS UNBOUNDED PRECEDING)""")
def trigger_or2(spark, sf_dir):
    return triggers.fire_or(arrays_of_events(spark, sf_dir), ["click", "view"]).select("timestep", "array_name", "click_total", "view_total")


ARRIVALS = ", arr AS (SELECT array_name, timestep, (event_id * 7919) % 10007 AS seq, event_id FROM ev)"


def _arrivals(spark, sf_dir):
    """Events in a scrambled order of arrival."""
    return cells_of_events(spark, sf_dir).withColumn("seq", F.expr("(event_id * 7919) % 10007")).select("array_name", "timestep", "event_id", F.struct("seq", "event_id").alias("order"))


@query(EV + ARRIVALS + """ SELECT * FROM (SELECT array_name, timestep, event_id, max(timestep) OVER (PARTITION BY array_name ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_timestep FROM arr)
WHERE timestep < last_timestep""")
def late_rejects(spark, sf_dir):
    return triggers.late(_arrivals(spark, sf_dir), "order").drop("order")


@query(EV + " SELECT array_name, timestep, count(*) AS n_arrivals FROM ev GROUP BY ALL HAVING count(*) > 1")
def duplicate_timesteps(spark, sf_dir):
    return triggers.repeated(cells_of_events(spark, sf_dir))


@query(EV + " SELECT CAST((timestep + rank) % 3 AS INTEGER) AS worker, count(*) AS n_chunks, CAST(sum(n_cells) AS BIGINT) AS n_cells FROM chunks GROUP BY 1")
def worker_round_robin(spark, sf_dir):
    return chunks_of_events(spark, sf_dir).groupBy(grid.worker_of(F.col("timestep"), F.col("rank"), 3).alias("worker")).agg(F.count("*").alias("n_chunks"), F.sum("n_cells").alias("n_cells"))


# feedback

FB = """WITH fb AS (SELECT event_type AS key, event_id AS seq, user_id % 50 AS timestep, CAST(event_id * 3 AS VARCHAR) AS value FROM events),
held AS (SELECT key, seq, timestep, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM fb) WHERE r <= 64),
firsts AS (SELECT key, timestep, arg_min(value, seq) AS value FROM held GROUP BY ALL)"""


def _feedback(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.expr("user_id % 50").alias("timestep"), F.expr("cast(event_id * 3 as string)").alias("value"))


@query(FB + " SELECT * FROM held")
def feedback_last_n(spark, sf_dir):
    return feedback.last_n(_feedback(spark, sf_dir), 64)


@query(FB + " SELECT a.key, a.timestep, f.value, f.value IS NOT NULL AS found FROM (SELECT DISTINCT key, timestep FROM fb) a LEFT JOIN firsts f USING (key, timestep)")
def feedback_lookup(spark, sf_dir):
    fb = _feedback(spark, sf_dir)
    return feedback.lookup(fb, fb.select("key", "timestep").distinct(), 64)


@query(FB + " SELECT a.key, a.timestep, coalesce(f.value, 'none') AS value, f.value IS NOT NULL AS found FROM (SELECT DISTINCT key, timestep + 25 AS timestep FROM fb) a LEFT JOIN firsts f USING (key, timestep)")
def feedback_default(spark, sf_dir):
    fb = _feedback(spark, sf_dir)
    return feedback.lookup(fb, fb.select("key", (F.col("timestep") + 25).alias("timestep")).distinct(), 64, "none")


# grids


@query("SELECT p_partkey, CAST((p_partkey % 24) // 12 AS INTEGER) AS x, CAST((p_partkey % 12) // 4 AS INTEGER) AS y, CAST(p_partkey % 4 AS INTEGER) AS z FROM part")
def cart_coords(spark, sf_dir):
    at = grid.coords(F.col("p_partkey") % 24, (2, 3, 4))
    return read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(at, "xyz", strict=True)])


@query("""SELECT p_partkey, CASE WHEN p_size % 5 - 1 BETWEEN 0 AND 2 THEN CAST((p_size % 5 - 1) * 4 + ((p_partkey % 9 - 3) % 4 + 4) % 4 AS INTEGER) END AS rank FROM part""")
def cart_rank(spark, sf_dir):
    at = (F.col("p_size") % 5 - 1, F.col("p_partkey") % 9 - 3)
    return read(spark, sf_dir, "part").select("p_partkey", grid.rank_of(at, (3, 4), (False, True)).alias("rank"))


# array algebra


@query(CELLS + " SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS smallest, max(value) AS largest, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std FROM cells")
def array_reduce(spark, sf_dir):
    out = A.reduce_all(matrix(spark, sf_dir))
    return out.select("n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "variance", "std")], "smallest", "largest")


@query(CELLS + " SELECT bool_or(value > 3) AS any_cell, bool_and(value > -2) AS all_cells FROM cells")
def array_any_all(spark, sf_dir):
    x = matrix(spark, sf_dir)
    return x.agg(A.any_cell(lambda v: v > 3).alias("any_cell"), A.all_cells(lambda v: v > -2).alias("all_cells"))


@query(CELLS + """ SELECT (SELECT i0 FROM cells ORDER BY value, i0, i1 LIMIT 1) AS min_i0, (SELECT i1 FROM cells ORDER BY value, i0, i1 LIMIT 1) AS min_i1, (SELECT min(value) FROM cells) AS smallest,
(SELECT i0 FROM cells ORDER BY value DESC, i0, i1 LIMIT 1) AS max_i0, (SELECT i1 FROM cells ORDER BY value DESC, i0, i1 LIMIT 1) AS max_i1, (SELECT max(value) FROM cells) AS largest""")
def array_argminmax(spark, sf_dir):
    return A.arg_extremes(matrix_cells(spark, sf_dir), ["i0", "i1"])


@query(CELLS + " SELECT i1, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS smallest, max(value) AS largest FROM cells GROUP BY i1")
def axis_reduce(spark, sf_dir):
    out = A.reduce_axes(matrix_cells(spark, sf_dir), ["i1"])
    return out.select("i1", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "smallest", "largest")


@query(CELLS + " SELECT i0, round(sum(2 * value + 1), 4) AS total FROM cells GROUP BY i0")
def elementwise_scalar(spark, sf_dir):
    out = A.elementwise(matrix(spark, sf_dir), lambda x: 2 * x + 1)
    return out.select(F.col("block_index").alias("i0"), F.round(A.chunk_sum(F.col("data")), 4).alias("total"))


@query(CELLS + " SELECT i0, round(sum(value * (value + 1)), 4) AS total FROM cells GROUP BY i0")
def elementwise_binary(spark, sf_dir):
    x = matrix(spark, sf_dir)
    out = A.binary(x, A.elementwise(x, lambda v: v + 1), ["block_index"], lambda a, b: a * b)
    return out.select(F.col("block_index").alias("i0"), F.round(A.chunk_sum(F.col("data")), 4).alias("total"))


@query(CELLS + """ SELECT bool_and(value * 2 / 2 = value) AS same, bool_and(CASE WHEN i0 = 7 AND i1 = 3 THEN value + 1 ELSE value END = value) AS one_cell_changed FROM cells""")
def array_equal(spark, sf_dir):
    x = matrix(spark, sf_dir)
    changed = A.elementwise(x, lambda v, i: F.when((F.col("block_index") == 7) & (i == 3), v + 1).otherwise(v))
    same = A.all_equal(x, A.elementwise(A.elementwise(x, lambda v: v * 2), lambda v: v / 2), ["block_index"])
    both = same.select(F.lit(0).alias("k"), F.col("equal").alias("same")).join(A.all_equal(x, changed, ["block_index"]).select(F.lit(0).alias("k"), F.col("equal").alias("one_cell_changed")), "k")
    return both.drop("k")


@query(CELLS + " SELECT i0, round(product(1 + value / 100), 6) AS product FROM cells GROUP BY i0")
def array_product(spark, sf_dir):
    rows = A.elementwise(matrix(spark, sf_dir), lambda v: 1 + v / 100)
    return A.product(rows, by=["block_index"]).select(F.col("block_index").alias("i0"), F.round("product", 6).alias("product"))


@query(CELLS + " SELECT i1, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std, bool_or(value > 3) AS any_cell, bool_and(value < 3) AS all_cells FROM cells GROUP BY i1")
def axis_moments(spark, sf_dir):
    cells = matrix_cells(spark, sf_dir)
    tests = A.any_all_axes(cells, ["i1"], lambda v: v > 3).select("i1", "any_cell").join(A.any_all_axes(cells, ["i1"], lambda v: v < 3).select("i1", "all_cells"), "i1")
    return A.reduce_axes(cells, ["i1"]).select("i1", F.round("variance", 6).alias("variance"), F.round("std", 6).alias("std")).join(tests, "i1")


@query(CELLS + " SELECT i0, arg_min(i1, (value, i1)) AS arg_smallest, arg_min(i1, (-value, i1)) AS arg_largest FROM cells GROUP BY i0")
def axis_argminmax(spark, sf_dir):
    return A.arg_axes(matrix_cells(spark, sf_dir), ["i0"], "i1")


@query(CELLS + " SELECT i0, round(sum(value * value), 4) AS total FROM cells GROUP BY i0")
def map_blocks_sum(spark, sf_dir):
    out = A.map_blocks(matrix(spark, sf_dir), lambda block: (block**2).sum(keepdims=True), (1, -1))
    return out.select(F.col("block_index").alias("i0"), F.round(F.col("data")[0], 4).alias("total"))


@query(CELLS + " SELECT i0 - 10 AS i0, CAST(i1 // 2 AS INTEGER) AS i1, value FROM cells WHERE i0 BETWEEN 10 AND 19 AND i1 % 2 = 0")
def array_slice(spark, sf_dir):
    """x[10:20, ::2]; the slice on i0 reaches the scan as a filter."""
    return A.take(matrix_cells(spark, sf_dir), {"i0": slice(10, 20), "i1": slice(None, None, 2)}, {"i0": 1 << 40, "i1": 1 << 20})


@query(EV + " SELECT array_name, timestep, round(total - lag(total) OVER w, 4) AS diff FROM arrays WINDOW w AS (PARTITION BY array_name ORDER BY timestep)")
def temporal_diff(spark, sf_dir):
    out = windows.trailing(arrays_of_events(spark, sf_dir), 2, n=F.count("*"), first=F.first("total"))
    return out.select("array_name", "timestep", F.when(F.col("n") == 2, F.round(F.col("total") - F.col("first"), 4)).alias("diff"))


@query(EV + " SELECT array_name, timestep, round(avg(total) OVER (PARTITION BY array_name ORDER BY timestep ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean FROM arrays")
def temporal_mean(spark, sf_dir):
    return windows.trailing(arrays_of_events(spark, sf_dir), 4, mean=F.avg("total")).select("array_name", "timestep", F.round("mean", 4).alias("mean"))


@query(CELLS + " SELECT i0, i1, round(lag(value) OVER w + lead(value) OVER w - 2 * value, 6) AS laplacian FROM cells WINDOW w AS (PARTITION BY i0 ORDER BY i1)")
def stencil(spark, sf_dir):
    return A.stencil(matrix_cells(spark, sf_dir), "i1", ["i0"]).select("i0", "i1", F.round("laplacian", 6).alias("laplacian"))


@query(CELLS + """ SELECT i0, i1, round(lag(value) OVER r + lead(value) OVER r - 2 * value + (lag(value) OVER c + lead(value) OVER c - 2 * value), 6) AS laplacian FROM cells
WHERE i0 < 200 WINDOW r AS (PARTITION BY i1 ORDER BY i0), c AS (PARTITION BY i0 ORDER BY i1)""")
def stencil_2d(spark, sf_dir):
    """On x[:200], over both axes."""
    cells = A.take(matrix_cells(spark, sf_dir), {"i0": slice(200)}, {"i0": 1 << 40})
    return A.stencil(cells, ["i0", "i1"]).select("i0", "i1", F.round("laplacian", 6).alias("laplacian"))


@query(CELLS + " SELECT CAST(least(floor((value + 4) / 0.5), 15) AS INTEGER) AS bin, count(*) AS n FROM cells WHERE value BETWEEN -4 AND 4 GROUP BY 1")
def histogram(spark, sf_dir):
    return A.histogram(matrix_cells(spark, sf_dir), -4, 4, 16)


@query(CELLS + " SELECT i0, i1, value FROM cells ORDER BY value DESC, i0, i1 LIMIT 25")
def topk(spark, sf_dir):
    return matrix_cells(spark, sf_dir).orderBy(F.desc("value"), "i0", "i1").limit(25)


@query(CELLS + " SELECT i1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM cells GROUP BY i1")
def quantile(spark, sf_dir):
    found = A.quantiles(matrix_cells(spark, sf_dir), ["i1"], [0.5, 0.9]).groupBy("i1")
    return found.agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("quantile"))), 6).alias(n) for q, n in ((0.5, "median"), (0.9, "p90"))))


@query(CELLS + " SELECT count(DISTINCT value) AS n_unique FROM cells")
def unique_values(spark, sf_dir):
    return matrix_cells(spark, sf_dir).agg(F.count_distinct("value").alias("n_unique"))


@query(CELLS + " SELECT i0, round(sqrt(sum(value * value)), 6) AS norm FROM cells GROUP BY i0")
def row_norms(spark, sf_dir):
    return matrix(spark, sf_dir).select(F.col("block_index").alias("i0"), F.round(F.sqrt(A.chunk_sum(F.transform("data", lambda x: x * x))), 6).alias("norm"))


@query(CELLS + " SELECT a.i1 AS i, b.i1 AS j, round(sum(a.value * b.value), 4) AS value FROM cells a JOIN cells b USING (i0) GROUP BY ALL")
def dot_gram(spark, sf_dir):
    return A.gram_matrix(matrix(spark, sf_dir)).select("i", "j", F.round("value", 4).alias("value"))


@query(CELLS + """, g AS (SELECT a.i1 AS k, b.i1 AS j, sum(a.value * b.value) AS v FROM cells a JOIN cells b USING (i0) WHERE b.i1 < 4 GROUP BY ALL)
SELECT i0, j AS i1, round(sum(value * v), 2) AS value FROM cells JOIN g ON i1 = k GROUP BY ALL""")
def matmul(spark, sf_dir):
    """X times the first four columns of its Gram matrix."""
    gram = A.gram_matrix(matrix(spark, sf_dir)).where("j < 4").select(F.col("i").alias("i0"), F.col("j").alias("i1"), "value")
    return A.matmul(matrix_cells(spark, sf_dir), gram).select("i0", "i1", F.round("value", 2).alias("value"))


@query(CELLS + " SELECT round(sum(value * (value + 1)), 4) AS dot FROM cells")
def dot_product(spark, sf_dir):
    x = matrix(spark, sf_dir)
    return A.dot(x, A.elementwise(x, lambda v: v + 1), ["block_index"]).select(F.round("dot", 4).alias("dot"))


@query("SELECT count(*) AS npartitions, CAST(min(len(embedding)) AS BIGINT) AS chunk_width, CAST(max(vec_id) + 1 AS BIGINT) AS rows FROM embeddings")
def npartitions(spark, sf_dir):
    return matrix(spark, sf_dir).agg(F.count_distinct("block_index").alias("npartitions"), F.min(F.size("data")).cast("bigint").alias("chunk_width"), (F.max("block_index") + 1).alias("rows"))
