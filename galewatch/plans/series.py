"""Queries over time series: precursors, lifecycle, escalation, scores, gates, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.meteo import relative_humidity
from ..operators import metrics, series
from ..operators.escalation import fit_escalation, publishable
from ..sources import sql as S
from ..sources.tables import monthly_series, observations, scores, table


def _cell_series(spark, d):
    return observations(spark, d).select(F.col("node_id").cast("string").alias("threat_id"), F.col("valid_time").alias("timestamp"), "value")


def tendency(spark: SparkSession, d: str) -> DataFrame:
    return series.tendency(_cell_series(spark, d), "value").select("threat_id", "timestamp", F.round("tendency", 8).alias("tendency"))


def anomaly_vs_mean(spark, d):
    return series.anomaly(_cell_series(spark, d), "value").select("threat_id", "timestamp", F.round("anomaly", 6).alias("anomaly"))


def neighbourhood_mean(spark, d):
    """Mean of cells within 1.5 degrees of (12.5, 78.5) per frame; of the nearest cell where none is."""
    near = F.expr("abs(latitude - 12.5) <= 1.5 and abs(longitude - 78.5) <= 1.5")
    apart = F.expr("struct(pow(latitude - 12.5, 2) + pow(longitude - 78.5, 2), node_id)")
    inside = F.when(near, F.col("value"))
    frames = observations(spark, d).groupBy("valid_time").agg(
        F.max(near).alias("any"), F.avg(inside).alias("mean"), F.count(inside).alias("cells"), F.min_by("value", apart).alias("nearest")
    )
    mean, cells = F.when(F.col("any"), F.col("mean")).otherwise(F.col("nearest")), F.when(F.col("any"), F.col("cells")).otherwise(F.col("nearest").isNotNull().cast("long"))
    return frames.select("valid_time", F.round(mean, 6).alias("mean"), cells.alias("cells"))


def trailing_window(spark, d):
    return series.trailing(_cell_series(spark, d), 240.0).select("threat_id", "timestamp", F.round("value", 6).alias("value"))


def precursor_summary(spark, d):
    """Rule-based text about the last step of every cell."""
    w = Window.partitionBy("threat_id").orderBy(F.desc("timestamp"))
    last = series.anomaly(series.tendency(_cell_series(spark, d), "value", 1.0), "value").withColumn("k", F.row_number().over(w)).where("k = 1")
    t, a = F.col("tendency"), F.col("anomaly")
    text = F.concat_ws(
        "; ",
        F.when(t <= -3, "rapid fall").when(t <= -1.5, "moderate fall").when(t >= 1.5, "rise").when(t.isNotNull(), "steady"),
        F.when(a >= 2, "warm anomaly").when(a <= -2, "cool anomaly"),
    )
    return last.select("threat_id", text.alias("summary"))


def precursor_text(spark, d):
    """The whole sentence about every node: its value's last step as pressure, and three other precursors made of it,
    each unknown for some nodes."""
    rows = series.anomaly(series.tendency(_cell_series(spark, d), "value", 1.0), "value")
    k = F.col("threat_id").cast("int")
    made = rows.select(
        "threat_id", "timestamp", F.when(k % 5 != 0, F.col("tendency") / 10).alias("pressure_tendency_3h_hpa"), F.when(k % 3 != 0, F.col("tendency") * 1e-6).alias("wind_divergence_s1"),
        F.when(k % 4 != 0, F.col("value") / 8).alias("precipitation_rate_mm3h"), F.when(k % 7 != 0, F.col("anomaly") / 6).alias("t2m_anomaly_k"),
    )
    return series.explanations(made)


def _phases(spark, d):
    return series.lifecycle_phases(monthly_series(spark, d))


def lifecycle_phases(spark, d):
    return _phases(spark, d).select("threat_id", "timestamp", "phase")


def phase_change_points(spark, d):
    return series.phase_changes(_phases(spark, d)).select("threat_id", "timestamp", "previous", "phase")


def weakening_events(spark, d):
    return series.drops(monthly_series(spark, d), "severity", 1000.0).select("threat_id", "timestamp", F.round("drop", 2).alias("drop"))


def escalation_threshold(spark, d):
    return series.escalation_threshold(monthly_series(spark, d), 0.75).select("threat_id", F.round("threshold", 4).alias("threshold"))


def _transition(spark, d):
    rows = series.tendency(monthly_series(spark, d), "severity", 1.0)
    return series.transition_rows(rows, 0.75, 3, ("tendency", "radius"))


def transition_rows(spark, d):
    return _transition(spark, d).select("threat_id", "timestamp", "label")


def transition_fit(spark, d):
    return fit_escalation(_transition(spark, d), ["severity", "tendency", "radius"])


def publish_gate(spark, d):
    s = scores(spark, d)
    both = metrics.brier_skill(s).join(metrics.roc_auc(s))  # one row each
    return both.select(publishable(F.col("skill"), F.col("auc")).alias("publish"), F.round("skill", 6).alias("skill"), F.round("auc", 6).alias("auc"))


def median_cadence(spark, d):
    return series.cadence_hours(monthly_series(spark, d)).withColumn("cadence_hours", F.round("cadence_hours", 4))


def confusion(spark, d):
    return metrics.confusion(scores(spark, d).select((F.col("p") >= 0.5).alias("predicted"), (F.col("y") == 1).alias("reference"))).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "false_alarm", "miss")})


def brier_skill(spark, d):
    return metrics.brier_skill(scores(spark, d)).withColumns({c: F.round(c, 6) for c in ("brier", "base_rate", "skill")})


def roc_auc(spark, d):
    return metrics.roc_auc(scores(spark, d)).withColumn("auc", F.round("auc", 6))


def reliability_table(spark, d):
    return metrics.reliability(scores(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_p", "rate")})


def ece(spark, d):
    return metrics.expected_calibration_error(scores(spark, d)).withColumn("ece", F.round("ece", 6))


def lead_time_error(spark, d):
    """Mean absolute difference, in days, between a line's ship date and its order's date plus 60."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.agg(F.round(F.avg(F.abs(F.datediff("l_shipdate", "o_orderdate") - 60)), 6).alias("mae_days"), F.count("l_shipdate").alias("n"))


def _verdicts(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("stage")).agg(F.avg("l_discount").alias("value"))
    return per.withColumn("verdict", metrics.verdict(F.col("value"), F.lit(0.0501), F.lit(0.0499), True))


def gate_verdicts(spark, d):
    return _verdicts(spark, d).select("stage", F.round("value", 6).alias("value"), "verdict")


def overall_verdict(spark, d):
    return metrics.overall(_verdicts(spark, d))


def severity_floor(spark, d):
    """Customers at or above a tier: below 3000 moderate, below 6000 severe, else extreme."""
    rank = F.when(F.col("c_acctbal") >= 6000, 3).when(F.col("c_acctbal") >= 3000, 2).otherwise(1)
    return table(spark, d, "customer").select("c_custkey", rank.alias("severity_rank")).where("severity_rank >= 2")


def alert_tiers(spark, d):
    obs = observations(spark, d)
    w = Window.partitionBy("node_id")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-6))
    tiers = obs.withColumn("z", z).withColumn("tier", F.when(F.col("z") >= 4, "severe").when(F.col("z") >= 3, "moderate").otherwise("low"))
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("z"), 6).alias("max_z"))


def humidity(spark, d):
    """Relative humidity with the price as temperature: 0 to 40 degrees, dew point 5 below."""
    t = F.col("p_retailprice") % 40
    return table(spark, d, "part").select("p_partkey", F.round(relative_humidity(t, t - 5), 6).alias("humidity"))


def contract_violations(spark, d):
    """Rows of lineitem that break a rule of their contract, by rule."""
    bad = {"discount_range": "NOT l_discount BETWEEN 0 AND 0.05", "quantity_limit": "l_quantity > 45", "status": "l_linestatus NOT IN ('O')"}
    counts = table(spark, d, "lineitem").agg(*[F.sum(F.expr(f"CAST({c} AS BIGINT)")).alias(n) for n, c in bad.items()])
    return counts.unpivot([], list(bad), "rule", "violations")


_SER = S.OBS + ", ser AS (SELECT node_id::VARCHAR AS threat_id, valid_time AS \"timestamp\", value FROM obs)"
_PH = S.SERIES + """, p0 AS (SELECT *, row_number() OVER w AS n, max(severity) OVER (PARTITION BY threat_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
 max(severity) OVER (PARTITION BY threat_id) AS peak, first_value(severity) OVER w AS fs, first_value(radius) OVER w AS frad, lag(severity) OVER w AS ps, lag(radius) OVER w AS pr FROM series WINDOW w AS (PARTITION BY threat_id ORDER BY "timestamp")),
p1 AS (SELECT *, (severity - ps) / greatest(abs(fs), 1e-12) AS di, (radius - pr) / greatest(abs(frad), 1e-12) AS dr FROM p0),
ph AS (SELECT threat_id, "timestamp", CASE WHEN n = 1 THEN 'FORMATION' WHEN severity < best THEN 'DECAY' WHEN severity = peak THEN 'PEAK' WHEN dr > 0 AND (NOT coalesce(di > 0, false) OR dr > di) THEN 'EXPANSION' WHEN di > 0 THEN 'INTENSIFICATION' ELSE 'FORMATION' END AS phase FROM p1)"""
_THR = S.SERIES + ", thr AS (SELECT threat_id, quantile_cont(severity, 0.75) AS threshold FROM series GROUP BY ALL)"
_AUC = S.SCORES + """, g AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scores GROUP BY p), rk AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM g),
au AS (SELECT (sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos)::DOUBLE * sum(n - pos)) AS auc FROM rk), br AS (SELECT avg((p - y) * (p - y)) AS brier, avg(y) AS base FROM scores), sk AS (SELECT brier, base, 1 - brier / (base * (1 - base)) AS skill FROM br)"""
_REL = S.SCORES + ", b AS (SELECT least(floor(p * 10) + 1, 10)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scores GROUP BY ALL)"
_GATE = "v AS (SELECT year(l_shipdate)::VARCHAR AS stage, avg(l_discount) AS value FROM lineitem GROUP BY ALL), g AS (SELECT *, CASE WHEN value >= 0.0501 THEN 'PASS' WHEN value >= 0.0499 THEN 'DEGRADE' ELSE 'SUPPRESS' END AS verdict FROM v)"
SQL = {
    "tendency": f"WITH {_SER} SELECT threat_id, \"timestamp\", round((value - lag(value) OVER (PARTITION BY threat_id ORDER BY \"timestamp\")) / 100, 8) AS tendency FROM ser",
    "anomaly_vs_mean": f"WITH {_SER} SELECT threat_id, \"timestamp\", round(value - avg(value) OVER (PARTITION BY threat_id), 6) AS anomaly FROM ser",
    "neighbourhood_mean": f"WITH {S.OBS} SELECT valid_time, round(avg(value), 6) AS mean, count(value) AS cells FROM obs WHERE abs(latitude - 12.5) <= 1.5 AND abs(longitude - 78.5) <= 1.5 GROUP BY ALL",
    "trailing_window": f"WITH {_SER}, m AS (SELECT *, max(\"timestamp\") OVER (PARTITION BY threat_id) AS l FROM ser) SELECT threat_id, \"timestamp\", round(value, 6) AS value FROM m WHERE \"timestamp\" >= l - INTERVAL 240 HOUR",
    "precursor_summary": f"""WITH {_SER}, m AS (SELECT threat_id, "timestamp", value - lag(value) OVER (PARTITION BY threat_id ORDER BY "timestamp") AS t, value - avg(value) OVER (PARTITION BY threat_id) AS a FROM ser),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY threat_id ORDER BY "timestamp" DESC) = 1)
SELECT threat_id, concat_ws('; ', CASE WHEN t <= -3 THEN 'rapid fall' WHEN t <= -1.5 THEN 'moderate fall' WHEN t >= 1.5 THEN 'rise' WHEN t IS NOT NULL THEN 'steady' END, CASE WHEN a >= 2 THEN 'warm anomaly' WHEN a <= -2 THEN 'cool anomaly' END) AS summary FROM l""",
    "precursor_text": f"""WITH {_SER}, m AS (SELECT threat_id, "timestamp" AS t, threat_id::INT AS k, value, value - lag(value) OVER (PARTITION BY threat_id ORDER BY "timestamp") AS td, value - avg(value) OVER (PARTITION BY threat_id) AS an FROM ser),
x AS (SELECT threat_id, t, CASE WHEN k % 5 <> 0 THEN td / 10 END AS p, CASE WHEN k % 3 <> 0 THEN td * 1e-6 END AS d, CASE WHEN k % 4 <> 0 THEN value / 8 END AS r, CASE WHEN k % 7 <> 0 THEN an / 6 END AS a FROM m),
l AS (SELECT threat_id, max_by(p, t) FILTER (p IS NOT NULL) AS p, max_by(d, t) FILTER (d IS NOT NULL) AS d, max_by(r, t) FILTER (r IS NOT NULL) AS r, max_by(a, t) FILTER (a IS NOT NULL) AS a FROM x GROUP BY threat_id),
w AS (SELECT threat_id, [y FOR y IN [CASE WHEN p < -3 THEN printf('{series._FALLS[0][1]}', p) WHEN p < -1.5 THEN printf('{series._FALLS[1][1]}', p) WHEN p > 1.5 THEN printf('{series._RISE[1]}', p) WHEN p IS NOT NULL THEN printf('{series._STEADY}', p) END,
 CASE WHEN d < -5e-5 THEN printf('{series._CONVERGES[0][1]}', d) WHEN d < -1e-5 THEN printf('{series._CONVERGES[1][1]}', d) END, CASE WHEN r > 10 THEN printf('{series._RAIN[0][1]}', r) WHEN r > 2 THEN printf('{series._RAIN[1][1]}', r) END,
 CASE WHEN a > 2 THEN printf('{series._WARM}', a) WHEN a < -2 THEN printf('{series._COLD}', a) END] IF y IS NOT NULL] AS y FROM l)
SELECT threat_id, CASE len(y) WHEN 0 THEN '{series._NOTHING}' WHEN 1 THEN printf('{series._ONE}', y[1]) ELSE printf('{series._MORE}', y[1], array_to_string(y[2:], '; ')) END AS summary FROM w""",
    "lifecycle_phases": f"WITH {_PH} SELECT * FROM ph",
    "phase_change_points": f"WITH {_PH}, q AS (SELECT *, lag(phase) OVER w AS previous, row_number() OVER w AS n FROM ph WINDOW w AS (PARTITION BY threat_id ORDER BY \"timestamp\")) SELECT threat_id, \"timestamp\", previous, phase FROM q WHERE n = 1 OR phase IS DISTINCT FROM previous",
    "weakening_events": f"WITH {S.SERIES}, q AS (SELECT *, lag(severity) OVER (PARTITION BY threat_id ORDER BY \"timestamp\") - severity AS d FROM series) SELECT threat_id, \"timestamp\", round(d, 2) AS \"drop\" FROM q WHERE d > 1000",
    "escalation_threshold": f"WITH {_THR} SELECT threat_id, round(threshold, 4) AS threshold FROM thr",
    "transition_rows": f"""WITH {_THR}, q AS (SELECT s.*, t.threshold, s.severity - lag(s.severity) OVER w AS td, count(s.severity) OVER (PARTITION BY s.threat_id ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS kn,
 max(s.severity) OVER (PARTITION BY s.threat_id ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS mx FROM series s JOIN thr t USING (threat_id) WINDOW w AS (PARTITION BY s.threat_id ORDER BY "timestamp"))
SELECT threat_id, "timestamp", (mx >= threshold)::INT AS label FROM q WHERE severity < threshold AND kn = 3 AND td IS NOT NULL""",
    "publish_gate": f"WITH {_AUC} SELECT skill > 0 AND auc > 0.5 AS publish, round(skill, 6) AS skill, round(auc, 6) AS auc FROM sk, au",
    "median_cadence": f"WITH {S.SERIES}, q AS (SELECT threat_id, date_diff('second', lag(\"timestamp\") OVER (PARTITION BY threat_id ORDER BY \"timestamp\"), \"timestamp\") / 3600.0 AS g FROM series) SELECT threat_id, round(CASE WHEN min(g) > 0 THEN quantile_cont(g, 0.5) END, 4) AS cadence_hours FROM q GROUP BY ALL",
    "confusion": f"WITH {S.SCORES}, c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM scores) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(1 - tp / (tp + fp), 6) AS false_alarm, round(1 - tp / (tp + fn), 6) AS miss FROM c",
    "brier_skill": f"WITH {_AUC} SELECT round(brier, 6) AS brier, round(base, 6) AS base_rate, round(skill, 6) AS skill FROM sk",
    "roc_auc": f"WITH {_AUC} SELECT round(auc, 6) AS auc FROM au",
    "reliability_table": f"WITH {_REL} SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM range(1, 11) r(bin) LEFT JOIN b ON b.bin = r.bin",
    "ece": f"WITH {_REL} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece FROM b",
    "lead_time_error": "SELECT round(avg(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60)), 6) AS mae_days, count(l_shipdate) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "gate_verdicts": f"WITH {_GATE} SELECT stage, round(value, 6) AS value, verdict FROM g",
    "overall_verdict": f"WITH {_GATE} SELECT max_by(verdict, CASE verdict WHEN 'PASS' THEN 0 WHEN 'DEGRADE' THEN 1 ELSE 2 END) AS overall FROM g",
    "severity_floor": "SELECT c_custkey, CASE WHEN c_acctbal >= 6000 THEN 3 ELSE 2 END::INT AS severity_rank FROM customer WHERE c_acctbal >= 3000",
    "alert_tiers": f"WITH {S.Z} SELECT CASE WHEN z >= 4 THEN 'severe' WHEN z >= 3 THEN 'moderate' ELSE 'low' END AS tier, count(*) AS n, round(max(z), 6) AS max_z FROM zs GROUP BY ALL",
    "humidity": "WITH t AS (SELECT p_partkey, p_retailprice % 40 AS t FROM part) SELECT p_partkey, round(100 * (6.112 * exp(17.67 * (t - 5) / (t - 5 + 243.5))) / (6.112 * exp(17.67 * t / (t + 243.5))), 6) AS humidity FROM t",
    "contract_violations": "SELECT 'discount_range' AS rule, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) AS violations FROM lineitem UNION ALL SELECT 'quantity_limit', count(*) FILTER (l_quantity > 45) FROM lineitem UNION ALL SELECT 'status', count(*) FILTER (l_linestatus NOT IN ('O')) FROM lineitem",
}
QUERIES = {f.__name__: f for f in (
    tendency, anomaly_vs_mean, neighbourhood_mean, trailing_window, precursor_summary, precursor_text, lifecycle_phases, phase_change_points, weakening_events, escalation_threshold,
    transition_rows, transition_fit, publish_gate, median_cadence, confusion, brier_skill, roc_auc, reliability_table, ece, lead_time_error, gate_verdicts, overall_verdict,
    severity_floor, alert_tiers, humidity, contract_violations,
)}
