"""Queries over gridded fields and the mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, detect, grids, mesh, metrics
from ..sources import sql as S
from ..sources.scratch import kept
from ..sources.tables import coarse_field, fine_field, observations, table


def _axes(fine: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(fine.select(F.col(c).cast("double").alias(f"{c}_t")).distinct() for c in ("i", "j"))


def _refined(spark, d):
    fine = fine_field(spark, d)
    return fine, grids.bilinear(coarse_field(fine), *_axes(fine))


def _pairs(spark, d):
    fine, made = _refined(spark, d)
    return fine.select("i", "j", F.col("value").alias("r")).join(made.select(F.col("i_t").cast("long").alias("i"), F.col("j_t").cast("long").alias("j"), F.col("value").alias("p")), ["i", "j"])


def bilinear_regrid(spark: SparkSession, d: str) -> DataFrame:
    return _refined(spark, d)[1].withColumn("value", F.round("value", 4))


def nearest_regrid(spark, d):
    fine = fine_field(spark, d)
    return grids.nearest(coarse_field(fine), *_axes(fine)).withColumn("value", F.round("value", 4))


def local_crop(spark, d):
    return grids.crop(fine_field(spark, d), (12, 5), (3, 9)).withColumn("value", F.round("value", 4))


def target_grid(spark, d):
    """Points of a grid with step 0.25 inside the rows of the coarse field, snapped to whole steps."""
    ends = coarse_field(fine_field(spark, d)).agg(F.min("i").alias("a"), F.max("i").alias("b"))
    steps = F.sequence(F.ceil(F.col("a") / 0.25), F.floor(F.col("b") / 0.25))
    return ends.select(F.explode(steps).alias("k")).select("k", F.round(F.col("k") * 0.25, 10).alias("coord"))


def neighbourhood_features(spark, d):
    got = grids.filter_features(fine_field(spark, d), 1)
    return got.select("i", "j", F.round(F.col("x")[1], 4).alias("centre"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.size("x").alias("width"))


def divergence(spark, d):
    g = grids.gradients(fine_field(spark, d))
    return g.select("i", "j", F.round(F.col("di") + F.col("dj"), 4).alias("divergence"))


def divergence_si(spark, d):
    """Divergence of mean prices (in thousands, as eastward wind) and quantities (northward) in 1/s, by parity of the line."""
    lines = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 10).alias("i"), (F.col("l_orderkey") % 10).alias("j"), (F.col("l_linenumber") % 2).alias("part"))
    winds = lines.agg((F.avg("l_extendedprice") / 1000).alias("u"), F.avg("l_quantity").alias("v"))
    field = winds.select("part", "i", "j", (20 - 0.25 * F.col("i")).alias("latitude"), (82 + 0.25 * F.col("j")).alias("longitude"), "u", "v")
    return grids.divergence(field, "u", "v", "part").select("part", "i", "j", F.round(F.col("divergence") * 1e5, 6).alias("divergence_1e5"))


def _rows(spark, d):
    return _pairs(spark, d).where("p is not null").select("i", "j", F.array(F.lit(1.0), F.col("p") / 1000).alias("x"), (F.col("r") / 1000).alias("y"))


def gram_matrix(spark, d):
    return grids.normal_equations(_rows(spark, d), 2).withColumn("s", F.round("s", 4))


def ridge_fit(spark, d):
    w = grids.ridge(grids.normal_equations(_rows(spark, d), 2), 2, 0.1)
    return _rows(spark, d).select("i", "j", (F.lit(float(w[0])) + float(w[1]) * F.col("x")[1]).alias("fitted"), "y")


def _mapped_pairs(spark, d):
    return kept(_pairs(spark, d).where("p is not null").select("i", "j", F.col("p").alias("x"), F.col("r").alias("y")))


def quantile_knots(spark, d):
    return grids.quantile_knots(_mapped_pairs(spark, d), 21).withColumns({c: F.round(c, 4) for c in ("x", "y")})


def quantile_map(spark, d):
    pairs = _mapped_pairs(spark, d)
    return grids.apply_quantile_map(pairs, grids.quantile_knots(pairs, 21)).select("i", "j", F.round("mapped", 3).alias("mapped"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in df.columns})


def field_errors(spark, d):
    return _rounded(metrics.field_errors(_pairs(spark, d)))


def peak_preservation(spark, d):
    return _rounded(metrics.peak_preservation(_pairs(spark, d)))


def percentile_error(spark, d):
    return _rounded(metrics.percentile_error(_pairs(spark, d)))


def footprint_overlap(spark, d):
    return _rounded(metrics.overlap(_pairs(spark, d), 38000.0))


def holdout_columns(spark, d):
    """Columns beyond the 70 % quantile of the distinct ones are held out."""
    return alignment.hold_out(fine_field(spark, d), "j", 0.3).select("i", "j", "held_out")


def mesh_nodes(spark, d):
    return mesh.nodes(observations(spark, d))


def mesh_edges(spark, d):
    return mesh.edges(mesh.nodes(observations(spark, d))).withColumn("w", F.round("w", 6))


def graph_smoothing(spark, d):
    obs = kept(observations(spark, d))
    return mesh.smooth(obs, kept(mesh.edges(mesh.nodes(obs)))).select("valid_time", "node_id", F.round("smoothed", 4).alias("smoothed"))


def persistence_skill(spark, d):
    obs = observations(spark, d)
    clim = detect.climatology(obs, "node_id")
    both = mesh.persistence(obs).where("previous is not null").join(clim, "node_id")
    e = lambda c: F.sqrt(F.avg(F.pow(F.col("value") - F.col(c), 2)))
    got = both.agg(e("previous").alias("persistence_rmse"), e("mean").alias("mean_rmse"))
    return _rounded(got.withColumn("improvement", F.when(F.col("persistence_rmse") == 0, 0.0).otherwise(100 * (1 - F.col("mean_rmse") / F.col("persistence_rmse")))))


def history_windows(spark, d):
    got = mesh.histories(observations(spark, d))
    return got.select("valid_time", "node_id", F.round(F.aggregate("history", F.lit(0.0), lambda a, v: a + v), 7).alias("total"))


def feature_moments(spark, d):
    return observations(spark, d, "day", True).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.count("value").alias("n"))


def domain_diagnostics(spark, d):
    half = observations(spark, d).withColumn("late", F.dayofmonth("valid_time") > 15)
    return half.groupBy("late").agg(*[F.round(f("value"), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))])


def loss_weights(spark, d):
    """1 / mean squared step of each event type, scaled to mean 1."""
    from pyspark.sql import Window

    obs = observations(spark, d, "day", True)
    w = Window.partitionBy("event_type", "node_id").orderBy("valid_time")
    raw = obs.withColumn("dv", F.col("value") - F.lag("value").over(w)).groupBy("event_type").agg((1 / F.greatest(F.avg(F.col("dv") * F.col("dv")), F.lit(1e-8))).alias("raw"))
    return raw.join(F.broadcast(raw.agg(F.avg("raw").alias("m")))).select("event_type", F.round(F.col("raw") / F.col("m"), 6).alias("weight"))  # one row


def split_assignment(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy(F.when(y <= 1995, "train").when(y <= 1996, "val").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))


def missing_hours(spark, d):
    """Hours between the first and the last that have no event, by number for each node."""
    obs = observations(spark, d, "hour")
    ends = obs.groupBy("node_id").agg(F.min("valid_time").alias("a"), F.max("valid_time").alias("b"))
    every = ends.select("node_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("valid_time"))
    return every.join(obs, ["node_id", "valid_time"], "left_anti").groupBy("node_id").agg(F.count(F.lit(1)).alias("missing"))


_PAIR = S.FINE + """, c AS (SELECT i AS ci, j AS cj, value AS v FROM fine WHERE i % 2 = 0 AND j % 2 = 0),
pr AS (SELECT f.i, f.j, f.value AS r, CASE WHEN f.i <= 18 AND f.j <= 18 THEN
 a.v * (1 - ui) * (1 - uj) + b.v * ui * (1 - uj) + e.v * (1 - ui) * uj + g.v * ui * uj END AS p
 FROM (SELECT *, least(i // 2 * 2, 16) AS li, least(j // 2 * 2, 16) AS lj, (i - least(i // 2 * 2, 16)) / 2.0::DOUBLE AS ui, (j - least(j // 2 * 2, 16)) / 2.0::DOUBLE AS uj FROM fine) f
 LEFT JOIN c a ON a.ci = li AND a.cj = lj LEFT JOIN c b ON b.ci = li + 2 AND b.cj = lj LEFT JOIN c e ON e.ci = li AND e.cj = lj + 2 LEFT JOIN c g ON g.ci = li + 2 AND g.cj = lj + 2)"""
_Q = "[" + ", ".join(f"{k / 20}" for k in range(21)) + "]"
_KNOT = _PAIR + f""", qq AS (SELECT quantile_cont(p, {_Q}) AS xs, quantile_cont(r, {_Q}) AS ys FROM pr WHERE p IS NOT NULL), kn0 AS (SELECT unnest(range(21))::INT AS k, unnest(xs) AS x, unnest(ys) AS y FROM qq),
kn AS (SELECT k, x, max(y) OVER (ORDER BY k) AS y, lag(x) OVER (ORDER BY k) AS b FROM kn0), knots AS (SELECT k, x, y FROM kn WHERE b IS NULL OR x > b)"""
_NODES = S.OBS + ", nd AS (SELECT (row_number() OVER (ORDER BY latitude, longitude) - 1)::BIGINT AS node_id, latitude, longitude FROM (SELECT DISTINCT latitude, longitude FROM obs))"
_EDGES = _NODES + """, ed AS (SELECT a.node_id AS src, b.node_id AS dst, 1 / sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)) AS w FROM nd a JOIN nd b
 ON (abs(abs(a.latitude - b.latitude) - 0.5) < 1e-4 AND abs(a.longitude - b.longitude) < 1e-4) OR (abs(abs(a.longitude - b.longitude) - 1.0) < 1e-4 AND abs(a.latitude - b.latitude) < 1e-4))"""
_TYPED = "t AS (" + S.OBS_BODY.format(unit="day").replace("AS valid_time,", "AS valid_time, event_type,") + ")"
SQL = {
    "bilinear_regrid": f"WITH {_PAIR} SELECT i::DOUBLE AS i_t, j::DOUBLE AS j_t, round(p, 4) AS value FROM pr",
    "nearest_regrid": f"WITH {S.FINE} SELECT f.i::DOUBLE AS i_t, f.j::DOUBLE AS j_t, CASE WHEN f.i <= 18 AND f.j <= 18 THEN round(n.value, 4) END AS value FROM fine f LEFT JOIN fine n ON n.i = f.i // 2 * 2 AND n.j = f.j // 2 * 2",
    "local_crop": f"WITH {S.FINE} SELECT i, j, round(value, 4) AS value FROM fine WHERE i BETWEEN 5 AND 12 AND j BETWEEN 3 AND 9",
    "target_grid": f"WITH {S.FINE}, e AS (SELECT min(i) AS a, max(i) AS b FROM fine WHERE i % 2 = 0 AND j % 2 = 0) SELECT k::BIGINT AS k, round(k * 0.25::DOUBLE, 10) AS coord FROM (SELECT unnest(range(ceil(a / 0.25)::BIGINT, floor(b / 0.25)::BIGINT + 1)) AS k FROM e)",
    "neighbourhood_features": f"""WITH {S.FINE}, o AS (SELECT unnest([-1, 0, 1]) AS d), nb AS (SELECT f.i, f.j, f.value AS c, n.value AS v FROM fine f, o a, o b, fine n WHERE n.i = least(greatest(f.i + a.d, 0), 19) AND n.j = least(greatest(f.j + b.d, 0), 19))
SELECT i, j, round(c, 4) AS centre, round(1 + c + sum(v - c), 4) AS total, 11::INT AS width FROM nb GROUP BY i, j, c""",
    "divergence": f"""WITH {S.FINE}, g AS (SELECT i, j, value, lag(value) OVER a AS bi, lead(value) OVER a AS ai, lag(value) OVER b AS bj, lead(value) OVER b AS aj FROM fine WINDOW a AS (PARTITION BY j ORDER BY i), b AS (PARTITION BY i ORDER BY j))
SELECT i, j, round(coalesce((ai - bi) / 2, ai - value, value - bi) + coalesce((aj - bj) / 2, aj - value, value - bj), 4) AS divergence FROM g""",
    "divergence_si": """WITH f AS (SELECT l_linenumber % 2 AS part, l_partkey % 10 AS i, l_orderkey % 10 AS j, avg(l_extendedprice) / 1000 AS u, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT a.part, a.i, a.j, CASE a.j WHEN 0 THEN e.u - a.u WHEN 9 THEN a.u - w.u ELSE (e.u - w.u) / 2 END AS du, CASE a.i WHEN 0 THEN a.v - s.v WHEN 9 THEN n.v - a.v ELSE (n.v - s.v) / 2 END AS dv FROM f a
 LEFT JOIN f e ON e.part = a.part AND e.i = a.i AND e.j = a.j + 1 LEFT JOIN f w ON w.part = a.part AND w.i = a.i AND w.j = a.j - 1 LEFT JOIN f n ON n.part = a.part AND n.j = a.j AND n.i = a.i - 1 LEFT JOIN f s ON s.part = a.part AND s.j = a.j AND s.i = a.i + 1)
SELECT part, i, j, round((du / (0.25 * pi() / 180 * 6371000 * cos(radians(18.875))) + dv / (0.25 * pi() / 180 * 6371000)) * 1e5, 6) AS divergence_1e5 FROM g""",
    "gram_matrix": f"WITH {_PAIR}, m AS (SELECT [1.0::DOUBLE, p / 1000, r / 1000] AS v FROM pr WHERE p IS NOT NULL), ix AS (SELECT unnest(range(3))::INT AS a) SELECT x.a, y.a AS b, round(sum(v[x.a + 1] * v[y.a + 1]), 4) AS s FROM m, ix x, ix y GROUP BY ALL",
    "quantile_knots": f"WITH {_KNOT} SELECT k, round(x, 4) AS x, round(y, 4) AS y FROM knots",
    "quantile_map": f"""WITH {_KNOT}, sp AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, lag(x) OVER (ORDER BY x) AS b FROM knots)
SELECT i, j, round(CASE WHEN x1 IS NULL OR p < x0 THEN y0 ELSE y0 + (p - x0) * (y1 - y0) / (x1 - x0) END, 3) AS mapped FROM pr JOIN sp ON (b IS NULL AND p < x0) OR (p >= x0 AND (x1 IS NULL OR p < x1)) WHERE p IS NOT NULL""",
    "field_errors": f"WITH {_PAIR} SELECT round(avg((p IS NOT NULL AND r IS NOT NULL)::INT), 4) AS valid_fraction, round(sqrt(avg((p - r) * (p - r))), 4) AS rmse, round(avg(abs(p - r)), 4) AS mae, round(avg(p - r), 4) AS bias FROM pr",
    "peak_preservation": f"WITH {_PAIR} SELECT round(max(p) / max(r), 4) AS peak_preservation FROM pr",
    "percentile_error": f"WITH {_PAIR}, q AS (SELECT abs(quantile_cont(p, 0.95) - quantile_cont(r, 0.95)) AS a, abs(quantile_cont(p, 0.99) - quantile_cont(r, 0.99)) AS b FROM pr) SELECT round(a, 4) AS p95_error, round(b, 4) AS p99_error, round((a + b) / 2, 4) AS mean_error FROM q",
    "footprint_overlap": f"WITH {_PAIR}, b AS (SELECT coalesce(p >= 38000, false) AS a, r >= 38000 AS b FROM pr), n AS (SELECT count(*) FILTER (a AND b) AS i, count(*) FILTER (a OR b) AS u, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) AS n FROM b) SELECT round(i / nullif(u, 0), 4) AS iou, round(2 * i / nullif(na + nb, 0), 4) AS dice, round(na / n, 4) AS predicted_share, round(nb / n, 4) AS reference_share, round(na / n - nb / n, 4) AS exceedance_change FROM n",
    "holdout_columns": f"WITH {S.FINE}, q AS (SELECT quantile_cont(j, 0.7) AS cut FROM (SELECT DISTINCT j FROM fine)) SELECT i, j, j >= cut AS held_out FROM fine, q",
    "mesh_nodes": f"WITH {_NODES} SELECT node_id, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude FROM nd",
    "mesh_edges": f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS w FROM ed",
    "graph_smoothing": f"""WITH {_EDGES}, al AS (SELECT * FROM ed UNION ALL SELECT node_id, node_id, 1.0 FROM nd), dg AS (SELECT dst, sum(w) AS d FROM al GROUP BY dst), nm AS (SELECT src, al.dst, w / sqrt(x.d * y.d) AS a FROM al JOIN dg x ON x.dst = al.dst JOIN dg y ON y.dst = al.src),
mv AS (SELECT valid_time, nm.dst AS node_id, sum(a * value) AS ax FROM obs JOIN nm ON nm.src = obs.node_id GROUP BY ALL) SELECT valid_time, node_id, round(0.6 * value + 0.4 * ax, 4) AS smoothed FROM obs JOIN mv USING (valid_time, node_id)""",
    "persistence_skill": f"WITH {S.OBS}, m AS (SELECT node_id, value, avg(value) OVER (PARTITION BY node_id) AS mean, lag(value) OVER (PARTITION BY node_id ORDER BY valid_time) AS prev FROM obs), e AS (SELECT sqrt(avg(pow(value - prev, 2))) AS a, sqrt(avg(pow(value - mean, 2))) AS b FROM m WHERE prev IS NOT NULL) SELECT round(a, 4) AS persistence_rmse, round(b, 4) AS mean_rmse, round(100 * (1 - b / a), 4) AS improvement FROM e",
    "history_windows": f"WITH {S.OBS}, h AS (SELECT valid_time, node_id, count(value) OVER w AS n, sum(value) OVER w AS s FROM obs WINDOW w AS (PARTITION BY node_id ORDER BY valid_time ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) SELECT valid_time, node_id, round(s, 7) AS total FROM h WHERE n = 6",
    "feature_moments": f"WITH {_TYPED} SELECT event_type, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(value) AS n FROM t GROUP BY ALL",
    "domain_diagnostics": f"WITH {S.OBS} SELECT day(valid_time) > 15 AS late, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS low, round(max(value), 4) AS high FROM obs GROUP BY ALL",
    "loss_weights": f"WITH {_TYPED}, s AS (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type, node_id ORDER BY valid_time) AS dv FROM t), r AS (SELECT event_type, 1 / greatest(avg(dv * dv), 1e-8) AS raw FROM s GROUP BY ALL) SELECT event_type, round(raw / (SELECT avg(raw) FROM r), 6) AS weight FROM r",
    "split_assignment": "SELECT CASE WHEN year(o_orderdate) <= 1995 THEN 'train' WHEN year(o_orderdate) <= 1996 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL",
    "missing_hours": f"WITH {S.OBS_HOUR}, e AS (SELECT node_id, min(valid_time) AS a, max(valid_time) AS b FROM obs GROUP BY ALL), h AS (SELECT node_id, unnest(range(a, b + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS valid_time FROM e) SELECT node_id, count(*) AS missing FROM h ANTI JOIN obs USING (node_id, valid_time) GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (
    bilinear_regrid, nearest_regrid, local_crop, target_grid, neighbourhood_features, divergence, divergence_si, gram_matrix, ridge_fit, quantile_knots, quantile_map, field_errors,
    peak_preservation, percentile_error, footprint_overlap, holdout_columns, mesh_nodes, mesh_edges, graph_smoothing, persistence_skill, history_windows, feature_moments,
    domain_diagnostics, loss_weights, split_assignment, missing_hours,
)}
