"""Queries over forecasts, out-of-fold scores, parameter sweeps and gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignment, downscaling, escalation, grids, horizons, metrics, series, serving
from ..sources import sql as S
from ..sources.scratch import kept
from ..sources.tables import coarse_field, fine_field, monthly_series, observations, table
from .grids import _PAIR, _pairs
from .series import _THR, _transition


def forward_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of four hours to a part's size in hours, ties to the even number."""
    k = horizons.steps_ahead(F.col("p_size").cast("double"), F.lit(4.0))
    return table(spark, d, "part").groupBy("p_size", k.alias("steps")).agg(F.count(F.lit(1)).alias("n"))


def horizon_frames(spark, d):
    """Errors of persistence one, three and six days ahead."""
    rows = horizons.horizon_frames(observations(spark, d), (1, 3, 6))
    e = F.col("prediction") - F.col("reference")
    return rows.groupBy("horizon").agg(F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


def rollout_mean(spark, d):
    """Three steps of "half of each of the last two values", fed back."""
    obs = observations(spark, d)
    w = Window.partitionBy("node_id").orderBy(F.desc("valid_time"))
    last = obs.select("node_id", "value", F.row_number().over(w).alias("k")).where("k <= 2")
    start = last.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "value"))), lambda s: s["value"]).alias("history")).where(F.size("history") == 2)
    return horizons.rollout(start, np.array([0.0, 0.5, 0.5]), 3).select("node_id", "step", F.round("prediction", 6).alias("prediction"))


def autoregression(spark, d):
    """Six-step ridge forecast of the last day of every node, fitted on the days before, three days ahead."""
    obs = observations(spark, d)
    rows = horizons.lag_rows(obs, 6)
    w = grids.ridge(grids.normal_equations(rows.select("x", "y"), 7), 7, 1.0)
    last = Window.partitionBy("node_id").orderBy(F.desc("valid_time"))
    start = rows.withColumn("k", F.row_number().over(last)).where("k = 1").select("node_id", F.concat(F.slice("x", 3, 5), F.array("y")).alias("history"))
    return horizons.rollout(start, w, 3).select("node_id", "step", F.round("prediction", 6).alias("prediction"))


def skill_by_type(spark, d):
    """RMSE and MAE of persistence and of the mean for every event type."""
    obs = observations(spark, d, "day", True)
    w = Window.partitionBy("event_type", "node_id").orderBy("valid_time")
    rows = obs.withColumn("persistence", F.lag("value").over(w)).withColumn("mean", F.avg("value").over(Window.partitionBy("event_type", "node_id"))).where("persistence is not null")
    got = horizons.skill_table(rows.select("event_type", "value", "persistence", "mean"), "event_type", "value", ("persistence", "mean"), "persistence")
    return got.withColumns({c: F.round(c, 5) for c in ("rmse", "mae", "improvement")})


def _fit_rows(spark, d):
    return _pairs(spark, d).where("p is not null").select("i", "j", F.array(F.lit(1.0), F.col("p") / 1000).alias("x"), (F.col("r") / 1000).alias("y"))


def alpha_sweep(spark, d):
    """Held-out error of four penalties on the last columns of a field."""
    rows = _fit_rows(spark, d)
    return horizons.alpha_sweep(rows.where("j < 15"), rows.where("j >= 15"), 2, (0.0, 1.0, 10.0, 100.0)).withColumn("rmse", F.round("rmse", 6))


def fit_quality(spark, d):
    """Share of the variance that a straight line through the refined field explains."""
    rss, tss = horizons.fit_quality(grids.normal_equations(_fit_rows(spark, d), 2), 2)
    return _fit_rows(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.lit(1 - rss / tss if tss else None), 5).alias("r2"))


def radius_sweep(spark, d):
    """Error of neighbourhood filters with radius 0, 1 and 2 that sharpen a smoothed field."""
    fine = fine_field(spark, d)
    smooth = grids.neighbourhood(fine, 1).groupBy("i", "j").agg(F.avg("value").alias("value"))
    return horizons.radius_sweep(smooth, fine, (0, 1, 2), 1.0).withColumn("rmse", F.round("rmse", 3))


def floored_prediction(spark, d):
    """A line that would give negative rain for the lowest prices, held at zero."""
    rows = fine_field(spark, d).select("i", "j", (F.col("value") / 1000 - 38).alias("v"))
    return rows.select("i", "j", F.round(horizons.floored(F.col("v"), "tp"), 6).alias("tp"), F.round(horizons.floored(F.col("v"), "t2m"), 6).alias("t2m"))


def method_comparison(spark, d):
    """Bilinear, nearest and the mean of the coarse field against the fine one."""
    fine = fine_field(spark, d)
    coarse = coarse_field(fine)
    axes = [fine.select(F.col(c).cast("double").alias(f"{c}_t")).distinct() for c in ("i", "j")]
    near = grids.nearest(coarse, *axes).select(F.col("i_t").cast("long").alias("i"), F.col("j_t").cast("long").alias("j"), F.col("value").alias("nearest"))
    rows = _pairs(spark, d).join(near, ["i", "j"]).join(F.broadcast(coarse.agg(F.avg("value").alias("mean"))))  # one row
    rows = rows.where("p is not null").select(F.lit("price").alias("field"), F.col("r").alias("value"), F.col("p").alias("bilinear"), "nearest", "mean")
    return horizons.skill_table(rows, "field", "value", ("bilinear", "nearest", "mean"), "nearest").withColumns({c: F.round(c, 4) for c in ("rmse", "mae", "improvement")})


def transition_refusals(spark, d):
    return escalation.refusals(_transition(spark, d))


def transition_folds(spark, d):
    """How many rows of each label every one of five folds has."""
    return horizons.stratified_folds(_transition(spark, d), 5, ["threat_id", "timestamp"]).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def transition_oof(spark, d):
    """Out-of-fold probabilities of all eligible months."""
    return horizons.out_of_fold(_transition(spark, d), ["severity", "tendency", "radius"])


def transition_serve(spark, d):
    """The last eligible month of every series whose own out-of-fold scores are better than its base rate and than chance."""
    scored = kept(horizons.out_of_fold(_transition(spark, d), ["severity", "tendency", "radius"]))
    s = scored.select("threat_id", F.col("probability").alias("p"), F.col("label").alias("y"))
    gate = metrics.brier_skill(s, "threat_id").join(metrics.roc_auc(s, group=("threat_id",)), "threat_id")
    gate = gate.select("threat_id", escalation.publishable(F.col("skill"), F.col("auc")).alias("publish"))
    return serving.latest_publishable(scored, gate).select("threat_id", "timestamp", F.round("probability", 6).alias("probability"))


def _sequence(spark, d):
    """Pairs of every second year: the mean price of a cell, and what its coarse grid gives by interpolation."""
    lines = table(spark, d, "lineitem").withColumn("valid_time", F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")).where("year(l_shipdate) % 2 = 0")
    fine = kept(lines.groupBy("valid_time", (F.col("l_partkey") % 20).cast("long").alias("i"), (F.col("l_orderkey") % 20).cast("long").alias("j")).agg((F.avg("l_extendedprice") / 1000).alias("value")))
    axes = [fine.select(F.col(c).cast("double").alias(f"{c}_t")).distinct() for c in ("i", "j")]
    made = grids.bilinear(coarse_field(fine), *axes, "valid_time")
    p = made.select("valid_time", F.col("i_t").cast("long").alias("i"), F.col("j_t").cast("long").alias("j"), F.col("value").alias("p"))
    return kept(p.join(fine.withColumnRenamed("value", "r"), ["valid_time", "i", "j"], "left"))


def interpolation_steps(spark, d):
    """Errors of the interpolated field at every time, over the last columns."""
    rows = alignment.hold_out(_sequence(spark, d), "j", 0.3).where("held_out and p is not null and r is not null").withColumnRenamed("p", "prediction")
    return rows.groupBy("valid_time").agg(*downscaling._errors()).withColumns({c: F.round(c, 5) for c in ("rmse", "mae", "bias", "peak_preservation")})


def downscaling_scores(spark, d):
    """Interpolated, filtered, and filtered and mapped field on columns that no fit has seen."""
    got = downscaling.evaluate(_sequence(spark, d))
    if got.scores is None:
        return spark.range(0).select(F.lit("").alias("method"), *[F.lit(None).cast(t).alias(c) for c, t in (("cells", "bigint"), ("rmse", "double"), ("mae", "double"), ("bias", "double"), ("peak_preservation", "double"))])
    return got.scores.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "bias", "peak_preservation")})


def weakening_flags(spark, d):
    """Steps that fall by more than a tolerance, and the same steps without one, which decides nothing."""
    rows = monthly_series(spark, d)
    one = lambda t: series.drop_flags(rows, "severity", t).groupBy(F.lit(t).cast("double").alias("tolerance"), "evaluated", F.col("event").cast("double").alias("event")).agg(F.count(F.lit(1)).alias("n"))
    return one(1000.0).unionByName(one(None))


def gate_cases(spark, d):
    """Verdicts of stages with and without a table, a known metric, own thresholds and a value."""
    per = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("value"))
    y = F.col("year")
    metric = F.when(y == 1993, "unknown").when(y % 2 == 0, "rmse").otherwise("iou")
    value = F.when(y != 1995, F.col("value"))
    got = metrics.gate(metric, value, y != 1992, F.lit(0.0501), F.lit(0.0499), F.when(y == 1997, 0.0), F.when(y == 1997, 0.0))
    return per.select("year", got.alias("verdict"))


_FOLDS = """rows_ AS (SELECT s.threat_id, s."timestamp", s.severity, t.threshold, s.severity - lag(s.severity) OVER w AS td, count(s.severity) OVER (PARTITION BY s.threat_id ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS kn,
 max(s.severity) OVER (PARTITION BY s.threat_id ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS mx FROM series s JOIN thr t USING (threat_id) WINDOW w AS (PARTITION BY s.threat_id ORDER BY "timestamp")),
el AS (SELECT threat_id, "timestamp", (mx >= threshold)::INT AS label FROM rows_ WHERE severity < threshold AND kn = 3 AND td IS NOT NULL)"""
_TYPED = "t AS (" + S.OBS_BODY.format(unit="day").replace("AS valid_time,", "AS valid_time, event_type,") + ")"
_SWEEP = _PAIR + """, xy AS (SELECT j, p / 1000 AS x, r / 1000 AS y FROM pr WHERE p IS NOT NULL), st AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy FROM xy WHERE j < 15),
al AS (SELECT unnest([0, 1, 2, 3])::INT AS k, unnest([0.0, 1.0, 10.0, 100.0])::DOUBLE AS alpha), er AS (SELECT k, alpha, sqrt(avg(pow(my + sxy / (sxx + alpha + 1e-9) * (x - mx) - y, 2))) AS rmse FROM xy, st, al WHERE j >= 15 GROUP BY ALL)"""
SQL = {
    "forward_steps": "SELECT p_size, greatest(1, round_even(p_size / 4.0, 0))::INT AS steps, count(*) AS n FROM part GROUP BY ALL",
    "horizon_frames": f"WITH {S.OBS}, h AS (SELECT unnest([1, 3, 6])::INT AS horizon), n AS (SELECT node_id, value, row_number() OVER (PARTITION BY node_id ORDER BY valid_time) AS k FROM obs) SELECT horizon, round(sqrt(avg(pow(a.value - b.value, 2))), 6) AS rmse, round(avg(abs(a.value - b.value)), 6) AS mae, count(*) AS n FROM n a, h, n b WHERE b.node_id = a.node_id AND b.k = a.k + horizon GROUP BY ALL",
    "rollout_mean": f"WITH {S.OBS}, l AS (SELECT node_id, value, row_number() OVER (PARTITION BY node_id ORDER BY valid_time DESC) AS k FROM obs), s AS (SELECT node_id, max(CASE WHEN k = 2 THEN value END) AS a, max(CASE WHEN k = 1 THEN value END) AS b FROM l WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2) SELECT node_id, unnest([1, 2, 3])::INT AS step, round(unnest([(a + b) / 2, (b + (a + b) / 2) / 2, ((a + b) / 2 + (b + (a + b) / 2) / 2) / 2]), 6) AS prediction FROM s",
    "skill_by_type": f"WITH {_TYPED}, m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type, node_id) AS mean, lag(value) OVER (PARTITION BY event_type, node_id ORDER BY valid_time) AS prev FROM t), e AS (SELECT event_type, sqrt(avg(pow(prev - value, 2))) AS pr, avg(abs(prev - value)) AS pm, sqrt(avg(pow(mean - value, 2))) AS mr, avg(abs(mean - value)) AS mm FROM m WHERE prev IS NOT NULL GROUP BY ALL) SELECT event_type, 'persistence' AS method, round(pr, 5) AS rmse, round(pm, 5) AS mae, 0.0::DOUBLE AS improvement FROM e UNION ALL SELECT event_type, 'mean', round(mr, 5), round(mm, 5), round(CASE WHEN pr = 0 THEN 0 ELSE 100 * (1 - mr / pr) END, 5) FROM e",
    "alpha_sweep": f"WITH {_SWEEP} SELECT k AS \"order\", alpha, round(rmse, 6) AS rmse, k = (SELECT arg_min(k, (rmse, k)) FROM er) AS chosen FROM er",
    "fit_quality": f"WITH {_PAIR} SELECT count(*) AS n, round(regr_r2(r / 1000, p / 1000), 5) AS r2 FROM pr WHERE p IS NOT NULL",
    "floored_prediction": f"WITH {S.FINE} SELECT i, j, round(greatest(value / 1000 - 38, 0.0), 6) AS tp, round(value / 1000 - 38, 6) AS t2m FROM fine",
    "method_comparison": f"WITH {_PAIR}, cm AS (SELECT avg(v) AS m FROM c), x AS (SELECT pr.r AS v, pr.p AS b, n.value AS ne, m FROM pr JOIN fine n ON n.i = pr.i // 2 * 2 AND n.j = pr.j // 2 * 2, cm WHERE pr.p IS NOT NULL), e AS (SELECT sqrt(avg(pow(b - v, 2))) AS br, avg(abs(b - v)) AS bm, sqrt(avg(pow(ne - v, 2))) AS nr, avg(abs(ne - v)) AS nm, sqrt(avg(pow(m - v, 2))) AS mr, avg(abs(m - v)) AS mm FROM x) SELECT 'price' AS field, 'bilinear' AS method, round(br, 4) AS rmse, round(bm, 4) AS mae, round(100 * (1 - br / nr), 4) AS improvement FROM e UNION ALL SELECT 'price', 'nearest', round(nr, 4), round(nm, 4), 0.0 FROM e UNION ALL SELECT 'price', 'mean', round(mr, 4), round(mm, 4), round(100 * (1 - mr / nr), 4) FROM e",
    "interpolation_steps": """WITH f AS (SELECT date_trunc('year', l_shipdate)::TIMESTAMP AS t, l_partkey % 20 AS i, l_orderkey % 20 AS j, avg(l_extendedprice) / 1000 AS v FROM lineitem WHERE year(l_shipdate) % 2 = 0 GROUP BY ALL),
k AS (SELECT *, least(i // 2 * 2, 16) AS li, least(j // 2 * 2, 16) AS lj FROM f WHERE i <= 18 AND j BETWEEN 14 AND 18), w AS (SELECT *, (i - li) / 2.0::DOUBLE AS u, (j - lj) / 2.0::DOUBLE AS s FROM k),
p AS (SELECT w.t, w.v AS r, a.v * (1 - u) * (1 - s) + b.v * u * (1 - s) + c.v * (1 - u) * s + e.v * u * s AS p FROM w JOIN f a ON a.t = w.t AND a.i = li AND a.j = lj JOIN f b ON b.t = w.t AND b.i = li + 2 AND b.j = lj JOIN f c ON c.t = w.t AND c.i = li AND c.j = lj + 2 JOIN f e ON e.t = w.t AND e.i = li + 2 AND e.j = lj + 2)
SELECT t AS valid_time, count(*) AS cells, round(sqrt(avg(pow(p - r, 2))), 5) AS rmse, round(avg(abs(p - r)), 5) AS mae, round(avg(p - r), 5) AS bias, round(max(p) / max(r), 5) AS peak_preservation FROM p GROUP BY t""",
    "transition_refusals": f"WITH {_THR}, {_FOLDS} SELECT threat_id, count(*) AS rows, sum(label)::BIGINT AS positives, CASE WHEN count(*) < 20 THEN 'too few rows' WHEN sum(label) < 5 THEN 'too few positives' WHEN count(*) - sum(label) < 2 THEN 'too few negatives' END AS refused FROM el GROUP BY ALL",
    "transition_folds": f"WITH {_THR}, {_FOLDS}, f AS (SELECT label AS l FROM el ORDER BY threat_id, \"timestamp\" LIMIT 1), p AS (SELECT label, (row_number() OVER (ORDER BY label <> l, label) - 1) % 5 AS fold FROM el, f) SELECT label, fold::INT AS fold, count(*) AS n FROM p GROUP BY ALL",
    "weakening_flags": f"WITH {S.SERIES}, q AS (SELECT lag(severity) OVER (PARTITION BY threat_id ORDER BY \"timestamp\") - severity AS d FROM series) SELECT 1000.0::DOUBLE AS tolerance, d IS NOT NULL AS evaluated, (d > 1000)::INT::DOUBLE AS event, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT NULL::DOUBLE, false, NULL::DOUBLE, count(*) FROM q",
    "gate_cases": "WITH v AS (SELECT year(l_shipdate) AS year, avg(l_discount) AS value FROM lineitem GROUP BY ALL) SELECT year::INT AS year, CASE WHEN year = 1992 THEN 'SUPPRESS' WHEN year IN (1993, 1995) THEN NULL WHEN year = 1997 THEN 'PASS' WHEN year % 2 = 0 THEN NULL WHEN value >= 0.0501 THEN 'PASS' WHEN value >= 0.0499 THEN 'DEGRADE' ELSE 'SUPPRESS' END AS verdict FROM v",
}
QUERIES = {f.__name__: f for f in (
    forward_steps, horizon_frames, rollout_mean, autoregression, skill_by_type, alpha_sweep, fit_quality, radius_sweep, floored_prediction, method_comparison,
    transition_refusals, transition_folds, transition_oof, transition_serve, interpolation_steps, downscaling_scores, weakening_flags, gate_cases,
)}
