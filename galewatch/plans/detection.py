"""Queries over the observation cube: climatology, extremes, regions, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, tracks
from ..sources import sql as S
from ..sources.scratch import kept
from ..sources.tables import observations, table, upsert

THRESHOLD = 1.0


def _r(*names: str, digits: int = 6) -> dict:
    return {n: F.round(n, digits) for n in names}


def _obs(spark, d):
    return observations(spark, d)


def _z(spark, d):
    obs = _obs(spark, d)
    return detect.anomalies(obs, detect.climatology(obs))


def _labels(spark, d):
    return detect.label_regions(detect.extremes(_z(spark, d), "high", THRESHOLD).select("valid_time", "node_id", "lat_i", "lon_i", "latitude", "longitude", "z"))


def _boxes(spark, d):
    return detect.region_boxes(_labels(spark, d))


def climatology_stats(spark: SparkSession, d: str) -> DataFrame:
    return detect.climatology(_obs(spark, d)).withColumns(_r("mean", "std"))


def coverage_guard(spark, d):
    return detect.coverage(detect.climatology(_obs(spark, d))).withColumns(_r("coverage"))


def zscore_cells(spark, d):
    return _z(spark, d).select("valid_time", "lat_i", "lon_i", F.round("z", 6).alias("z"))


def flag_extremes_high(spark, d):
    return detect.extremes(_z(spark, d), "high", THRESHOLD).select("valid_time", "node_id", F.round("z", 6).alias("z"))


def flag_extremes_low(spark, d):
    return detect.extremes(_z(spark, d), "low", THRESHOLD).select("valid_time", "node_id", F.round("z", 6).alias("z"))


def region_labels(spark, d):
    return _labels(spark, d).select("valid_time", "node_id", "label_id")


def region_runs(spark, d):
    """The same labels by runs of cells and components of the runs, without a frame in one task."""
    flags = detect.extremes(_z(spark, d), "high", THRESHOLD).select("valid_time", "node_id", "lat_i", "lon_i")
    return detect.label_runs(flags).select("valid_time", "node_id", "label_id")


def region_boxes(spark, d):
    return _boxes(spark, d).withColumns(_r("centroid_lat", "centroid_lon", "peak_zscore"))


def top_box_per_frame(spark, d):
    return detect.top_boxes(_boxes(spark, d)).select("valid_time", "label_id", F.round("peak_zscore", 6).alias("peak_zscore"), "cell_count")


def frame_series(spark, d):
    frames = _obs(spark, d).select("valid_time").distinct()
    return detect.frame_series(frames, _boxes(spark, d)).withColumns(_r("max_z"))


def peak_frame(spark, d):
    per = _obs(spark, d).groupBy("valid_time").agg(F.max("value").alias("peak"))
    return per.agg(F.max_by("valid_time", F.struct("peak", "valid_time")).alias("valid_time"), F.round(F.max("peak"), 6).alias("peak"))


def bbox_area(spark, d):
    return detect.with_area(_boxes(spark, d)).select("valid_time", "label_id", F.round("area_km2", 1).alias("area_km2"))


def _top_steps(spark, d):
    return tracks.steps(detect.top_boxes(kept(_boxes(spark, d))))


def haversine_steps(spark, d):
    return _top_steps(spark, d).select("valid_time", F.round("distance_km", 4).alias("distance_km"))


def bearing_steps(spark, d):
    return _top_steps(spark, d).where("distance_km > 0").select("valid_time", F.round("bearing_deg", 4).alias("bearing_deg"))


def speed_steps(spark, d):
    return _top_steps(spark, d).select("valid_time", F.round("speed_kmh", 6).alias("speed_kmh"))


def track_gating(spark, d):
    boxes = kept(_boxes(spark, d))  # labelled once for both sides
    frames = _obs(spark, d).select("valid_time").distinct()
    got = tracks.gated_pairs(boxes, frames, 400.0, None, 1.5)
    return got.select(F.col("a_valid_time").alias("valid_time"), F.col("a_label_id").alias("a"), F.col("b_label_id").alias("b"), F.round("cost_km", 4).alias("cost_km"), F.round("iou", 6).alias("iou"))


def _tracked(spark, d):
    one = F.lit("all").alias("event")
    frames = _obs(spark, d).select("valid_time", one).distinct()
    return tracks.track(kept(_boxes(spark, d)).select("*", one), frames, 400.0, 1, min_iou=0.0, max_dz=1.5)


def track_assign(spark, d):
    return _tracked(spark, d)


def trajectories(spark, d):
    return tracks.trajectories(_tracked(spark, d))


def trajectory_upsert(spark, d):
    """Later orders of a customer replace earlier ones; customers without later ones stay."""
    orders = table(spark, d, "orders").groupBy("o_custkey", (F.year("o_orderdate") >= 1996).alias("late")).agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    return upsert(orders.where("not late").drop("late"), orders.where("late").drop("late"), "o_custkey")


def _paired(spark, d):
    """Reference tracks by month, and predictions that miss some days, stray on others and change their id late."""
    day, odd = F.dayofmonth("valid_time"), F.month("valid_time") % 2 == 1
    top = detect.top_boxes(kept(_boxes(spark, d))).select("valid_time", "centroid_lat", "centroid_lon", F.concat(F.lit("T"), F.month("valid_time").cast("string")).alias("threat_id"))
    moved = top.where(day % 7 != 0).withColumn("centroid_lat", F.col("centroid_lat") + F.when(day % 5 == 0, 3.0).otherwise(0.2))
    return top, moved.withColumn("threat_id", F.concat("threat_id", F.when(odd & (day > 20), "b").otherwise("")))


def reference_steps(spark, d):
    ref, pred = _paired(spark, d)
    return tracks.matched_steps(ref, pred, 150.0).select("threat_id", "valid_time", F.round("km", 4).alias("km"), "p_id")


def tracking_scores(spark, d):
    ref, pred = _paired(spark, d)
    got = tracks.tracking_scores(tracks.matched_steps(ref, pred, 150.0), ref, pred)
    return got.withColumns(_r("mean_km", "rms_km", "continuity", "id_consistency", "duration_error_hours"))


_DIST = S.HAV.format(a="centroid_lat", b="la", c="centroid_lon", d="lo")
_STEP = S.TOP + """, st AS (SELECT *, lead(centroid_lat) OVER w AS la, lead(centroid_lon) OVER w AS lo, lead(valid_time) OVER w AS nt FROM top WINDOW w AS (ORDER BY valid_time))
SELECT valid_time, {what} FROM st WHERE nt IS NOT NULL"""
_PAIR = S.TOP + """, ref AS (SELECT valid_time, centroid_lat, centroid_lon, 'T' || month(valid_time) AS threat_id FROM top),
pred AS (SELECT valid_time, centroid_lat + CASE WHEN day(valid_time) % 5 = 0 THEN 3.0 ELSE 0.2 END AS la, centroid_lon AS lo, threat_id || CASE WHEN month(valid_time) % 2 = 1 AND day(valid_time) > 20 THEN 'b' ELSE '' END AS p_id FROM ref WHERE day(valid_time) % 7 <> 0),
j AS (SELECT threat_id, valid_time, p_id, """ + _DIST + """ AS km0 FROM ref LEFT JOIN pred USING (valid_time)),
k AS (SELECT threat_id, valid_time, CASE WHEN km0 <= 150 THEN km0 END AS km, CASE WHEN km0 <= 150 THEN p_id END AS p_id FROM j)"""

SQL = {
    "climatology_stats": f"WITH {S.CLIM} SELECT lat_i, lon_i, round(mean, 6) AS mean, round(std, 6) AS std, n FROM clim",
    "coverage_guard": f"WITH {S.CLIM} SELECT round(avg((mean IS NOT NULL)::INT), 6) AS coverage, avg((mean IS NOT NULL)::INT) >= 0.9 AS sufficient, count(*) AS cells FROM clim",
    "zscore_cells": f"WITH {S.Z} SELECT valid_time, lat_i, lon_i, round(z, 6) AS z FROM zs",
    "flag_extremes_high": f"WITH {S.Z} SELECT valid_time, node_id, round(z, 6) AS z FROM zs WHERE z > 1.0",
    "flag_extremes_low": f"WITH {S.Z} SELECT valid_time, node_id, round(z, 6) AS z FROM zs WHERE -z > 1.0",
    "region_labels": f"WITH RECURSIVE {S.REGION} SELECT valid_time, node_id, label_id FROM labels_",
    "region_runs": f"WITH RECURSIVE {S.REGION} SELECT valid_time, node_id, label_id FROM labels_",
    "region_boxes": f"WITH RECURSIVE {S.BOX} SELECT valid_time, label_id, lat_min, lat_max, lon_min, lon_max, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon, round(peak_zscore, 6) AS peak_zscore, cell_count FROM boxes",
    "top_box_per_frame": f"WITH RECURSIVE {S.TOP} SELECT valid_time, label_id, round(peak_zscore, 6) AS peak_zscore, cell_count FROM top",
    "frame_series": f"WITH RECURSIVE {S.BOX}, fr AS (SELECT DISTINCT valid_time FROM obs) SELECT fr.valid_time, round(max(peak_zscore), 6) AS max_z, coalesce(sum(cell_count), 0)::BIGINT AS cells, count(label_id) AS regions, count(label_id) > 0 AS detected FROM fr LEFT JOIN boxes b ON b.valid_time = fr.valid_time GROUP BY fr.valid_time",
    "peak_frame": f"WITH {S.OBS}, p AS (SELECT valid_time, max(value) AS peak FROM obs GROUP BY ALL) SELECT valid_time, round(peak, 6) AS peak FROM p ORDER BY p.peak DESC, valid_time DESC LIMIT 1",
    "bbox_area": f"WITH RECURSIVE {S.BOX} SELECT valid_time, label_id, round(({S.HAV.format(a='lat_min', b='lat_max', c='lon_min', d='lon_min')}) * ({S.HAV.format(a='lat_min', b='lat_min', c='lon_min', d='lon_max')}), 1) AS area_km2 FROM boxes",
    "haversine_steps": "WITH RECURSIVE " + _STEP.format(what=f"round({_DIST}, 4) AS distance_km"),
    "bearing_steps": "WITH RECURSIVE " + _STEP.format(what="round((degrees(atan2(sin(radians(lo) - radians(centroid_lon)) * cos(radians(la)), cos(radians(centroid_lat)) * sin(radians(la)) - sin(radians(centroid_lat)) * cos(radians(la)) * cos(radians(lo) - radians(centroid_lon)))) + 360) % 360, 4) AS bearing_deg") + f" AND {_DIST} > 0",
    "speed_steps": "WITH RECURSIVE " + _STEP.format(what=f"round({_DIST} / (date_diff('second', valid_time, nt) / 3600.0), 6) AS speed_kmh"),
    "track_gating": f"""WITH RECURSIVE {S.BOX}, fr AS (SELECT valid_time, row_number() OVER (ORDER BY valid_time) AS k FROM (SELECT DISTINCT valid_time FROM obs)),
n AS (SELECT b.*, fr.k FROM boxes b JOIN fr USING (valid_time)),
m AS (SELECT a.valid_time, a.label_id AS a, b.label_id AS b, {S.HAV.format(a='a.centroid_lat', b='b.centroid_lat', c='a.centroid_lon', d='b.centroid_lon')} AS cost, abs(a.peak_zscore - b.peak_zscore) AS dz,
 greatest(least(a.lat_max, b.lat_max) - greatest(a.lat_min, b.lat_min), 0.0) * greatest(least(a.lon_max, b.lon_max) - greatest(a.lon_min, b.lon_min), 0.0) AS i,
 (a.lat_max - a.lat_min) * (a.lon_max - a.lon_min) + (b.lat_max - b.lat_min) * (b.lon_max - b.lon_min) AS s FROM n a JOIN n b ON b.k = a.k + 1)
SELECT valid_time, a, b, round(cost, 4) AS cost_km, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0.0 END, 6) AS iou FROM m WHERE cost <= 400 AND dz <= 1.5""",
    "trajectory_upsert": "WITH o AS (SELECT o_custkey, year(o_orderdate) >= 1996 AS late, max(o_orderdate) AS \"last\", count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, \"last\", n FROM o WHERE late UNION ALL SELECT o_custkey, \"last\", n FROM o WHERE NOT late AND o_custkey NOT IN (SELECT o_custkey FROM o WHERE late)",
    "reference_steps": f"WITH RECURSIVE {_PAIR} SELECT threat_id, valid_time, round(km, 4) AS km, p_id FROM k",
    "tracking_scores": f"""WITH RECURSIVE {_PAIR}, per AS (SELECT threat_id, count(DISTINCT p_id) AS ids, count(p_id) AS hits, max(p_id) AS p_id FROM k GROUP BY ALL),
rh AS (SELECT threat_id, date_diff('second', min(valid_time), max(valid_time)) / 3600.0 AS h FROM ref GROUP BY ALL HAVING count(*) >= 2), ph AS (SELECT p_id, date_diff('second', min(valid_time), max(valid_time)) / 3600.0 AS h FROM pred GROUP BY ALL HAVING count(*) >= 2)
SELECT round(avg(km), 6) AS mean_km, round(sqrt(avg(km * km)), 6) AS rms_km, round(avg((p_id IS NOT NULL)::INT), 6) AS continuity,
 (SELECT round(count(*) FILTER (ids = 1) / nullif(count(*) FILTER (hits > 0), 0)::DOUBLE, 6) FROM per) AS id_consistency,
 (SELECT round(avg(abs(rh.h - ph.h)), 6)::DOUBLE FROM per JOIN rh USING (threat_id) JOIN ph USING (p_id) WHERE ids = 1) AS duration_error_hours FROM k""",
}
QUERIES = {f.__name__: f for f in (
    climatology_stats, coverage_guard, zscore_cells, flag_extremes_high, flag_extremes_low, region_labels, region_runs, region_boxes, top_box_per_frame, frame_series,
    peak_frame, bbox_area, haversine_steps, bearing_steps, speed_steps, track_gating, track_assign, trajectories, trajectory_upsert, reference_steps, tracking_scores,
)}
