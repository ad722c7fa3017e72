"""Queries through files and streams: what goes out by a sink comes back by a reader, and streams catch up with tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..operators import alignment, detect, tracks
from ..sources import sinks
from ..sources import sql as S
from ..sources.scratch import kept, new_folder
from ..sources.tables import best_track, observations, read_threats, select_track, table
from ..streaming.frames import frame_means, streamed_anomalies
from ..streaming.runs import caught_up
from ..streaming.tracker import streamed_tracks
from .contracts import threats
from .detection import _boxes, _obs


def _written_tracks(spark, d):
    """Orders as a best-track file: a customer is a storm, every seventh wind is blank, every eleventh latitude no number."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    path = new_folder(spark, "tracks")
    rows = o.select(
        F.concat(F.lit("NI"), "o_custkey").alias("SID"), F.year("o_orderdate").cast("string").alias("SEASON"), F.concat(F.lit(" storm "), F.col("o_custkey") % 25).alias("NAME"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), F.col("o_orderstatus").alias("NATURE"),
        F.when(k % 11 == 0, "n/a").otherwise((k % 40).cast("string")).alias("LAT"), (50 + k % 60).cast("string").alias("LON"), F.when(k % 7 == 0, " ").otherwise((20 + k % 100).cast("string")).alias("USA_WIND"),
    )
    units = spark.range(1).select(*[F.lit(u).alias(c) for c, u in zip(rows.columns, (" ", "Year", " ", " ", " ", "degrees_north", "degrees_east", "kts"), strict=True)])
    rows.unionByName(units).write.csv(path, header=True)
    return best_track(spark, path)


def best_track_file(spark: SparkSession, d: str) -> DataFrame:
    """Seasons of the storms read back: the units row is gone, what is no number is unknown."""
    got = _written_tracks(spark, d)
    return got.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.count("lat").alias("places"), F.count("usa_wind").alias("winds"), F.round(F.avg("lat"), 6).alias("mean_lat"), F.max("iso_time").alias("last"))


def selected_track(spark, d):
    """One storm name of one season, whatever its case."""
    return select_track(_written_tracks(spark, d), name="Storm 3", season=1995).select("sid", "iso_time", "lat", "lon")


def threat_records(spark, d):
    """Threats written as records and read back by their schema."""
    rows = threats(spark, d).select("threat_id", "severity", F.round("peak", 2).alias("peak"), "orders")
    path = new_folder(spark, "records")
    sinks.write_records(rows, path, source="orders")
    return read_threats(spark, f"{path}/records", rows.schema, lines=True).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders"), F.round(F.max("peak"), 2).alias("peak"))


def frame_records(spark, d):
    """A detector's run: frames and the way of the strongest region through them, written and read back."""
    boxes = kept(_boxes(spark, d))
    frames = detect.frame_series(_obs(spark, d).select("valid_time").distinct(), boxes)
    path = new_folder(spark, "run")
    sinks.write_frames(frames, detect.top_boxes(boxes).select("valid_time", "centroid_lat", "centroid_lon"), path)
    back = spark.read.schema(frames.schema).json(f"{path}/frames")
    way = spark.read.schema("valid_time timestamp_ntz, centroid_lat double, centroid_lon double").json(f"{path}/trajectory")
    return back.join(way, "valid_time", "left").select("valid_time", "cells", "detected", F.round("max_z", 6).alias("max_z"), F.round("centroid_lat", 6).alias("lat"))


def split_tables(spark, d):
    """Orders below their split, year and month, counted from the folders."""
    path = new_folder(spark, "splits")
    sinks.write_splits(table(spark, d, "orders").withColumnRenamed("o_orderdate", "valid_time"), path, last_train=1995, last_validate=1996)
    return spark.read.parquet(path).groupBy("split", "year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def box_features(spark, d):
    """GeoJSON of the boxes, read back: closed rings and their properties."""
    made = sinks.geojson(_boxes(spark, d).select("valid_time", "label_id", "lat_min", "lat_max", "lon_min", "lon_max", "cell_count"))
    shape = "struct<geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<valid_time: timestamp_ntz, label_id: bigint, cell_count: bigint>>"
    f = F.from_json("value", shape)
    ring = f["geometry"]["coordinates"][0]
    return made.select(f["properties"]["valid_time"].alias("valid_time"), f["properties"]["label_id"].alias("label_id"), F.size(ring).alias("points"), (ring[0] == ring[4]).alias("closed"), ring[2][1].alias("north"), ring[2][0].alias("east"))


def canonical_frames(spark, d):
    """Frames whose time axis and variable come under other names."""
    field = alignment.canonical_time(observations(spark, d).withColumnRenamed("value", "msl"))
    return field.groupBy("time").agg(F.round(F.avg(alignment.variable_column(field, "mean_sea_level_pressure")), 6).alias("mean"))


def streamed_means(spark, d):
    """Hourly cell means of streamed events, up to two hours before the newest: later windows are still open."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    got = caught_up(events, frame_means)
    return got.groupBy("node_id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum("value"), 4).alias("total"))


def streamed_zscores(spark, d):
    """Streamed cells against a climatology at rest."""
    obs = kept(observations(spark, d))
    clim = kept(detect.climatology(obs, "node_id").select("node_id", "mean", "std"))
    got = caught_up(obs.select("valid_time", "node_id", "value"), lambda s: streamed_anomalies(s, clim))
    return got.select("valid_time", "node_id", F.round("z", 6).alias("z"))


def streamed_track_ids(spark, d):
    """The ids of ``track_assign`` from a stream: boxes, frames without any, and a last frame that moves the watermark on."""
    at = F.col("valid_time").cast("timestamp").alias("valid_time")
    boxes = kept(_boxes(spark, d))
    frames = _obs(spark, d).select("valid_time").distinct()
    rest = [c for c in boxes.columns if c != "valid_time"]
    rows = frames.join(boxes, "valid_time", "left").select(F.lit("all").alias("event"), at, *rest)
    end = frames.agg((F.max("valid_time") + F.expr("INTERVAL 400 DAYS")).cast("timestamp").alias("valid_time")).select(F.lit("end").alias("event"), "valid_time", *[F.lit(None).cast(boxes.schema[c].dataType).alias(c) for c in rest])
    got = caught_up(rows.unionByName(end), lambda s: streamed_tracks(s, 400.0, 1, "400 days", 0.0, 1.5))
    return got.select("event", F.col("valid_time").cast("timestamp_ntz").alias("valid_time"), "label_id", "centroid_lat", "centroid_lon", "threat_id")


def crossed_frames(spark, d):
    """Frames that a track may enter from an earlier one: where tracks cannot be cut."""
    one = F.lit("all").alias("event")
    boxes = kept(_boxes(spark, d).select("*", one))
    frames = kept(_obs(spark, d).select("valid_time", one).distinct())
    cut = tracks.segments(boxes, frames, 400.0, 1, "event", 0.0, 1.5)
    return cut.groupBy("segment").agg(F.count(F.lit(1)).alias("frames"), F.min("valid_time").alias("first"))


def segment_lengths(spark, d):
    """How far the strongest region goes in each segment, in all."""
    top = detect.top_boxes(kept(_boxes(spark, d)))
    steps = tracks.steps(top).withColumn("month", F.date_trunc("month", "valid_time").cast("timestamp_ntz"))
    first = F.struct("valid_time", "centroid_lat", "centroid_lon")
    got = steps.groupBy("month").agg(F.sum("distance_km").alias("km"), F.min_by(first, "valid_time").alias("a"), F.max_by(first, "valid_time").alias("b"))
    straight = haversine_km(F.col("a.centroid_lat"), F.col("a.centroid_lon"), F.col("b.centroid_lat"), F.col("b.centroid_lon"))
    return got.select("month", F.round("km", 3).alias("km"), F.round(straight, 3).alias("straight_km"))


_KM = S.HAV.format(a="centroid_lat", b="la", c="centroid_lon", d="lo")
_NEAR = S.HAV.format(a="a.centroid_lat", b="b.centroid_lat", c="a.centroid_lon", d="b.centroid_lon")
SQL = {
    "best_track_file": """SELECT year(o_orderdate)::INT AS season, count(*) AS rows, count(*) FILTER (o_orderkey % 11 <> 0) AS places, count(*) FILTER (o_orderkey % 7 <> 0) AS winds,
 round(avg(o_orderkey % 40) FILTER (o_orderkey % 11 <> 0), 6) AS mean_lat, max(date_trunc('second', o_orderdate))::TIMESTAMP AS "last" FROM orders GROUP BY ALL""",
    "selected_track": "SELECT 'NI' || o_custkey AS sid, date_trunc('second', o_orderdate)::TIMESTAMP AS iso_time, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 40)::DOUBLE END AS lat, (50 + o_orderkey % 60)::DOUBLE AS lon FROM orders WHERE o_custkey % 25 = 3 AND year(o_orderdate) = 1995",
    "threat_records": """WITH t AS (SELECT max(o_totalprice) AS peak, count(*) AS orders FROM orders GROUP BY year(o_orderdate), o_orderpriority)
SELECT CASE floor(peak)::BIGINT % 3 WHEN 0 THEN 'moderate' WHEN 1 THEN 'severe' ELSE 'extreme' END AS severity, count(*) AS n, sum(orders)::BIGINT AS orders, round(max(round(peak, 2)), 2) AS peak FROM t GROUP BY ALL""",
    "frame_records": f"""WITH RECURSIVE {S.TOP}, fr AS (SELECT DISTINCT valid_time FROM obs), g AS (SELECT fr.valid_time, round(max(peak_zscore), 6) AS max_z, coalesce(sum(cell_count), 0)::BIGINT AS cells, count(label_id) > 0 AS detected FROM fr LEFT JOIN boxes b ON b.valid_time = fr.valid_time GROUP BY fr.valid_time)
SELECT g.valid_time, cells, detected, max_z, round(centroid_lat, 6) AS lat FROM g LEFT JOIN top ON top.valid_time = g.valid_time""",
    "split_tables": "SELECT CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) <= 1996 THEN 'validate' ELSE 'test' END AS split, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
    "box_features": f"WITH RECURSIVE {S.BOX} SELECT valid_time, label_id, 5::INT AS points, true AS closed, lat_max AS north, lon_max AS east FROM boxes",
    "canonical_frames": f"WITH {S.OBS} SELECT valid_time AS time, round(avg(value), 6) AS mean FROM obs GROUP BY ALL",
    "streamed_means": """WITH w AS (SELECT user_id % 66 AS node_id, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events)
SELECT node_id, count(*) AS windows, round(sum(v), 4) AS total FROM w, m WHERE h + INTERVAL 1 HOUR <= wm GROUP BY node_id""",
    "streamed_zscores": f"WITH {S.Z} SELECT valid_time, node_id, round(z, 6) AS z FROM zs",
    "crossed_frames": f"""WITH RECURSIVE {S.BOX}, fr AS (SELECT valid_time, row_number() OVER (ORDER BY valid_time) AS k FROM (SELECT DISTINCT valid_time FROM obs)), n AS (SELECT b.*, fr.k FROM boxes b JOIN fr USING (valid_time)),
m AS (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON b.k BETWEEN a.k + 1 AND a.k + 2 WHERE {_NEAR} <= 400 AND abs(a.peak_zscore - b.peak_zscore) <= 1.5), s AS (SELECT k, valid_time, sum((NOT EXISTS (SELECT 1 FROM m WHERE m.a < fr.k AND m.b >= fr.k))::INT) OVER (ORDER BY k) AS segment FROM fr)
SELECT segment::BIGINT AS segment, count(*) AS frames, min(valid_time) AS "first" FROM s GROUP BY ALL""",
    "segment_lengths": f"""WITH RECURSIVE {S.TOP}, st AS (SELECT *, lead(centroid_lat) OVER w AS la, lead(centroid_lon) OVER w AS lo FROM top WINDOW w AS (ORDER BY valid_time)), g AS (SELECT date_trunc('month', valid_time)::TIMESTAMP AS month, sum({_KM}) AS km, arg_min(centroid_lat, valid_time) AS centroid_lat, arg_min(centroid_lon, valid_time) AS centroid_lon, arg_max(centroid_lat, valid_time) AS la, arg_max(centroid_lon, valid_time) AS lo FROM st WHERE la IS NOT NULL GROUP BY ALL)
SELECT month, round(km, 3) AS km, round({_KM}, 3) AS straight_km FROM g""",
}
QUERIES = {f.__name__: f for f in (
    best_track_file, selected_track, threat_records, frame_records, split_tables, box_features, canonical_frames, streamed_means, streamed_zscores, streamed_track_ids,
    crossed_frames, segment_lengths,
)}
