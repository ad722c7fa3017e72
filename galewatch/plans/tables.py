"""Queries through tables that the engine writes: regions, bundles, moments; sessions of extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, moments
from ..sources import bundles, regions
from ..sources import sql as S
from ..sources.scratch import kept, new_folder
from ..sources.tables import observations
from ..streaming.tracker import track_sessions
from .detection import THRESHOLD, _z

#: Regions of the mesh by its rows.
BANDS = ("south", "middle", "north")


def _banded(spark, d):
    band = F.element_at(F.array(*map(F.lit, BANDS)), (F.floor(F.col("lat_i") / 4) + 1).cast("int"))
    return observations(spark, d).withColumn("region", band)


def _layout(spark, d):
    path = new_folder(spark, "regions")
    regions.write_regions(_banded(spark, d), path)
    return path


def region_scan(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one region, read from its own folder."""
    rows = regions.of_region(spark, _layout(spark, d), "middle")
    return rows.groupBy("valid_time").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("value"), 6).alias("mean"))


def region_join_scan(spark, d):
    """Cells of the regions whose peak is among the two highest, which the job finds out on its way."""
    path = _layout(spark, d)
    peaks = regions.read_regions(spark, path).groupBy("region").agg(F.max("value").alias("peak"))
    wanted = kept(peaks.orderBy(F.desc("peak"), "region").limit(2))
    return regions.of_regions(spark, path, wanted).groupBy("region").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 4).alias("total"))


def bundle_export(spark, d):
    """A full cube of frames and nodes (0 where nothing was seen), written as a bundle once its parts agree."""
    obs = kept(observations(spark, d))
    times, nodes = obs.select("valid_time").distinct(), kept(obs.select("node_id", "latitude", "longitude").distinct())
    cube = times.join(nodes.select("node_id")).join(obs.select("valid_time", "node_id", "value"), ["valid_time", "node_id"], "left").fillna(0.0, ["value"])
    ends = times.agg(F.count(F.lit(1)).alias("n"), F.min("valid_time").alias("a"), F.max("valid_time").alias("b")).first()
    record = {"frames": ends["n"], "nodes": nodes.count(), "features": ["value"], "first": str(ends["a"]), "last": str(ends["b"])}
    path = new_folder(spark, "bundle")
    bundles.check_bundle(cube, record, times, nodes, ("value",), path, hours=24.0)
    return spark.read.parquet(path).groupBy("node_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 6).alias("total"))


def monthly_moments(spark, d):
    """Mean and deviation of every event type from a table of parts that was filled half month by half month."""
    typed = observations(spark, d, "day", True)
    path = new_folder(spark, "moments")
    for part in (typed.where("dayofmonth(valid_time) <= 15"), typed):  # the second run replaces what is there
        moments.add_months(part, path, "value", "valid_time", "event_type")
    return moments.statistics(spark, path, "event_type").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def standardised_cells(spark, d):
    """Cells of every type less the mean of their type over its deviation, both merged from daily parts."""
    typed = kept(observations(spark, d, "day", True))
    daily = moments.parts(typed, "value", "event_type", "valid_time")
    stats = moments.merged(daily, "event_type").withColumn("std", moments.deviation())
    return moments.standardised(typed, stats, "value", "event_type").select("event_type", "node_id", "valid_time", F.round("value", 5).alias("value"))


def extreme_sessions(spark, d):
    """Stretches of extremes of every node without a pause of more than two days."""
    flags = detect.extremes(_z(spark, d), "high", THRESHOLD).select(F.col("node_id").cast("string").alias("threat_id"), "valid_time")
    return track_sessions(flags, "60 hours").select("threat_id", "first", "last", "points")


_BANDED = S.OBS + ", bd AS (SELECT *, CASE lat_i // 4 WHEN 0 THEN 'south' WHEN 1 THEN 'middle' ELSE 'north' END AS region FROM obs)"
_TYPED = "t AS (" + S.OBS_BODY.format(unit="day").replace("AS valid_time,", "AS valid_time, event_type,") + ")"
SQL = {
    "region_scan": f"WITH {_BANDED} SELECT valid_time, count(*) AS cells, round(avg(value), 6) AS mean FROM bd WHERE region = 'middle' GROUP BY ALL",
    "region_join_scan": f"WITH {_BANDED}, p AS (SELECT region FROM bd GROUP BY region ORDER BY max(value) DESC, region LIMIT 2) SELECT region, count(*) AS cells, round(sum(value), 4) AS total FROM bd WHERE region IN (SELECT region FROM p) GROUP BY ALL",
    "bundle_export": f"WITH {S.OBS}, f AS (SELECT count(DISTINCT valid_time) AS n FROM obs) SELECT node_id, max(f.n) AS frames, round(sum(value), 6) AS total FROM obs, f GROUP BY node_id",
    "monthly_moments": f"WITH {_TYPED} SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM t GROUP BY ALL",
    "standardised_cells": f"WITH {_TYPED} SELECT event_type, node_id, valid_time, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 5) AS value FROM t",
    "extreme_sessions": f"""WITH {S.FLAG}, s AS (SELECT node_id, valid_time, coalesce((valid_time - lag(valid_time) OVER (PARTITION BY node_id ORDER BY valid_time) >= INTERVAL 60 HOUR)::INT, 1) AS fresh FROM flags),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY node_id ORDER BY valid_time) AS n FROM s) SELECT node_id::VARCHAR AS threat_id, min(valid_time) AS "first", max(valid_time) AS "last", count(*) AS points FROM k GROUP BY node_id, n""",
}
QUERIES = {f.__name__: f for f in (region_scan, region_join_scan, bundle_export, monthly_moments, standardised_cells, extreme_sessions)}
