"""Queries behind the serving views: windows around peaks, metric tables, overlays, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect, serving
from ..operators.quantiles import exact_quantiles
from ..sources import sql as S
from ..sources.scratch import kept
from ..sources.tables import fine_field, monthly_series, observations, table
from .detection import _DIST, _STEP, _top_steps


def relocation_events(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the strongest region that are longer than 150 km."""
    return _top_steps(spark, d).where("distance_km > 150").select("valid_time", F.round("distance_km", 4).alias("distance_km"))


def event_window(spark, d):
    """Frames at most three days from the frame with the highest value."""
    per = observations(spark, d).groupBy("valid_time").agg(F.max("value").alias("peak"))
    at = per.agg(F.max_by("valid_time", F.struct("peak", "valid_time")).alias("at"))
    near = F.abs(F.datediff("valid_time", "at")) <= 3
    return per.join(F.broadcast(at), near).select("valid_time", F.round("peak", 6).alias("peak"))  # one row


def field_summary(spark, d):
    fine, v = kept(fine_field(spark, d)), F.col("value")
    p95 = F.lit(exact_quantiles(fine, "value", (0.95,))[0]).cast("double")
    return fine.agg(*[F.round(x, 4).alias(n) for n, x in (("peak", F.max(v)), ("trough", F.min(v)), ("p95", p95), ("missing", F.avg(v.isNull().cast("double"))))])


def _monthly_tables(spark, d):
    """A metric table for every month and priority: mean price, and its largest order if above 400,000."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.max(F.when(F.col("o_totalprice") > 400_000, F.col("o_totalprice"))).alias("large")
    )


def metric_means(spark, d):
    """Mean of every metric over its tables; tables in which it is NULL do not count."""
    long = _monthly_tables(spark, d).unpivot(["o_orderpriority"], ["mean_price", "large"], "metric", "value")
    return long.groupBy("o_orderpriority", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("tables"))


def metric_union(spark, d):
    """Two metric tables side by side; names that only one of them has keep NULL for the other."""
    lines = table(spark, d, "lineitem")
    a = lines.where("l_quantity < 3").groupBy(F.concat("l_returnflag", "l_linestatus").alias("metric")).agg(F.round(F.avg("l_extendedprice"), 4).alias("low"))
    b = lines.where("l_quantity > 48 and l_returnflag <> 'A'").groupBy(F.concat("l_returnflag", "l_linestatus").alias("metric")).agg(F.round(F.avg("l_extendedprice"), 4).alias("high"))
    return a.join(b, "metric", "full_outer").select("metric", "low", "high")


def shortest_horizon(spark, d):
    """For every supplier the shortest delay among its returned lines."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_returnflag = 'R'")
    waits = lines.select("l_suppkey", F.datediff("l_shipdate", "o_orderdate").alias("days"), "l_orderkey")
    return serving.shortest(waits, "days", "l_suppkey", "l_orderkey")


def fallback_overlay(spark, d):
    """Open orders of a customer where there are some, else its finished ones."""
    o = table(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderstatus") == "O").alias("open")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("open"))
    return o.withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "open", "n")


def severity_history(spark, d):
    """Distinct order states of each priority, sorted, and how long its series lasts."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.count(F.lit(1)).alias("n")
    )
    return o.select("o_orderpriority", "states", F.when(F.col("n") >= 2, F.col("days")).alias("days"))


def frame_blocks(spark, d):
    """Complete blocks of 66 consecutive events as steps and nodes: mean of each node over the steps."""
    e = table(spark, d, "events").select("event_id", "value")
    row = e.select(F.col("event_id").alias("row"), "value")
    steps = row.select(F.floor(F.col("row") / 66).cast("long").alias("step"), (F.col("row") % 66).alias("node_id"), "value")
    whole = steps.groupBy("step").agg(F.count(F.lit(1)).alias("n")).where("n = 66").select("step")
    return steps.join(whole, "step").groupBy("node_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("steps"))


def primary_track(spark, d):
    """The priority with most months, the first by name among equals."""
    per = monthly_series(spark, d).groupBy("threat_id").agg(F.count(F.lit(1)).alias("n"))
    best = per.agg(F.max("n").alias("n"))
    return per.join(F.broadcast(best), "n").agg(F.min("threat_id").alias("threat_id"), F.max("n").alias("n"))  # one row


def flagged_area(spark, d):
    """Flagged area of every frame: cells above one deviation times the area of a mesh cell there."""
    obs = observations(spark, d)
    z = detect.anomalies(obs, detect.climatology(obs)).where("z > 1.0")
    area = 0.5 * 1.0 * F.pow(F.lit(111.32), 2) * F.cos(F.radians("latitude"))
    return z.groupBy("valid_time").agg(F.round(F.sum(area), 3).alias("area_km2"), F.count(F.lit(1)).alias("cells"))



_TABLES = "mt AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, avg(o_totalprice) AS mean_price, max(CASE WHEN o_totalprice > 400000 THEN o_totalprice END) AS large FROM orders GROUP BY ALL)"
SQL = {
    "relocation_events": "WITH RECURSIVE " + _STEP.format(what=f"round({_DIST}, 4) AS distance_km") + f" AND {_DIST} > 150",
    "event_window": f"WITH {S.OBS}, p AS (SELECT valid_time, max(value) AS peak FROM obs GROUP BY ALL), t AS (SELECT valid_time AS a FROM p ORDER BY peak DESC, valid_time DESC LIMIT 1) SELECT valid_time, round(peak, 6) AS peak FROM p, t WHERE abs(date_diff('day', a, valid_time)) <= 3",
    "field_summary": f"WITH {S.FINE} SELECT round(max(value), 4) AS peak, round(min(value), 4) AS trough, round(quantile_cont(value, 0.95), 4) AS p95, round(avg((value IS NULL)::INT), 4) AS missing FROM fine",
    "metric_means": f"WITH {_TABLES}, l AS (SELECT o_orderpriority, 'mean_price' AS metric, mean_price AS value FROM mt UNION ALL SELECT o_orderpriority, 'large', large FROM mt) SELECT o_orderpriority, metric, round(avg(value), 6) AS mean, count(value) AS tables FROM l GROUP BY ALL",
    "metric_union": "WITH a AS (SELECT l_returnflag || l_linestatus AS metric, round(avg(l_extendedprice), 4) AS low FROM lineitem WHERE l_quantity < 3 GROUP BY ALL), b AS (SELECT l_returnflag || l_linestatus AS metric, round(avg(l_extendedprice), 4) AS high FROM lineitem WHERE l_quantity > 48 AND l_returnflag <> 'A' GROUP BY ALL) SELECT coalesce(a.metric, b.metric) AS metric, low, high FROM a FULL JOIN b ON a.metric = b.metric",
    "shortest_horizon": "SELECT l_suppkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY date_diff('day', o_orderdate::DATE, l_shipdate::DATE), l_orderkey) = 1",
    "fallback_overlay": "WITH o AS (SELECT o_custkey, o_orderstatus = 'O' AS \"open\", count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, \"open\", n FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY \"open\" DESC) = 1",
    "severity_history": "SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, CASE WHEN count(*) >= 2 THEN date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) END::INT AS days FROM orders GROUP BY ALL",
    "frame_blocks": "WITH s AS (SELECT event_id // 66 AS step, event_id % 66 AS node_id, value FROM events), w AS (SELECT step FROM s GROUP BY step HAVING count(*) = 66) SELECT node_id, round(avg(value), 6) AS mean, count(*) AS steps FROM s JOIN w USING (step) GROUP BY ALL",
    "primary_track": f"WITH {S.SERIES}, p AS (SELECT threat_id, count(*) AS n FROM series GROUP BY ALL) SELECT min(threat_id) AS threat_id, max(n) AS n FROM p WHERE n = (SELECT max(n) FROM p)",
    "flagged_area": f"WITH {S.Z} SELECT valid_time, round(sum(0.5 * pow(111.32, 2) * cos(radians(latitude))), 3) AS area_km2, count(*) AS cells FROM zs WHERE z > 1.0 GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (
    relocation_events, event_window, field_summary, metric_means, metric_union, shortest_horizon, fallback_overlay, severity_history, frame_blocks, primary_track, flagged_area,
)}
