"""Time series of threats: tendencies, lifecycle phases, escalation labels, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def by_time(key: str = "threat_id", time: str = "timestamp"):
    return Window.partitionBy(key).orderBy(time)


def tendency(rows: DataFrame, value: str, scale: float = 100.0, key: str = "threat_id", time: str = "timestamp") -> DataFrame:
    """Change since the step before, NULL at the first."""
    return rows.withColumn("tendency", (F.col(value) - F.lag(value).over(by_time(key, time))) / scale)


def anomaly(rows: DataFrame, value: str, key: str = "threat_id") -> DataFrame:
    """Difference from the mean over the whole series."""
    return rows.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(key)))


def trailing(rows: DataFrame, hours: float, key: str = "threat_id", time: str = "timestamp") -> DataFrame:
    """Rows at most ``hours`` before the last one of their series."""
    last = F.max(time).over(Window.partitionBy(key))
    return rows.withColumn("_last", last).where(F.col(time) >= F.col("_last") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")).drop("_last")


def relative_change(value: str, key: str = "threat_id", time: str = "timestamp") -> Column:
    """Change since the row before over the size of the first value; NULL without both."""
    first = F.first(value, ignorenulls=True).over(by_time(key, time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (F.col(value) - F.lag(value).over(by_time(key, time))) / F.greatest(F.abs(first), F.lit(TINY))


def lifecycle_phases(rows: DataFrame, intensity: str = "severity", radius: str = "radius") -> DataFrame:
    """Phase of every row by the first rule that fits.

    Nothing known at all: NULL. First row: formation. No intensity: expansion if the radius grew,
    else formation. No earlier intensity: formation. Below the highest so far: decay. At the
    highest of all: peak. Radius growing and (intensity not, or less): expansion. Intensity
    growing: intensification. Else formation.
    """
    w = by_time()
    every = Window.partitionBy("threat_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumns({
        "_n": F.row_number().over(w), "_best": F.max(intensity).over(past), "_peak": F.max(intensity).over(every),
        "_any": F.count(intensity).over(every) + F.count(radius).over(every), "_di": relative_change(intensity), "_dr": relative_change(radius),
    })
    grows = F.coalesce(F.col("_dr") > 0, F.lit(False))
    stronger = F.coalesce(F.col("_di") > 0, F.lit(False))
    phase = (
        F.when(F.col("_any") == 0, None)
        .when(F.col("_n") == 1, "FORMATION")
        .when(F.col(intensity).isNull(), F.when(grows, "EXPANSION").otherwise("FORMATION"))
        .when(F.col("_best").isNull(), "FORMATION")
        .when(F.col(intensity) < F.col("_best"), "DECAY")
        .when(F.col(intensity) == F.col("_peak"), "PEAK")
        .when(grows & (~stronger | (F.col("_dr") > F.col("_di"))), "EXPANSION")
        .when(stronger, "INTENSIFICATION")
        .otherwise("FORMATION")
    )
    return made.withColumn("phase", phase).drop("_n", "_best", "_peak", "_any", "_di", "_dr")


def phase_changes(phases: DataFrame) -> DataFrame:
    """Rows whose phase differs from the one before; the first row always."""
    w = by_time()
    return phases.withColumns({"previous": F.lag("phase").over(w), "_n": F.row_number().over(w)}).where((F.col("_n") == 1) | ~F.col("phase").eqNullSafe(F.col("previous"))).drop("_n")


def drops(rows: DataFrame, value: str, tolerance: float | None) -> DataFrame:
    """Falls by more than the tolerance since the step before; without one nothing is evaluated."""
    fall = F.lag(value).over(by_time()) - F.col(value)
    made = rows.withColumn("drop", fall)
    return made.where(F.col("drop") > tolerance) if tolerance is not None else made.where("false")


def drop_flags(rows: DataFrame, value: str, tolerance: float | None) -> DataFrame:
    """Every step with drop, evaluated (whether there is a tolerance and a step before) and event (NULL where
    not evaluated)."""
    fall = F.lag(value).over(by_time()) - F.col(value)
    made = rows.withColumn("drop", fall).withColumn("evaluated", fall.isNotNull() if tolerance is not None else F.lit(False))
    return made.withColumn("event", F.when(F.col("evaluated"), F.col("drop") > F.lit(tolerance).cast("double")))


def escalation_threshold(rows: DataFrame, q: float, value: str = "severity") -> DataFrame:
    """Quantile of the known values of each series; ValueError unless 0 < q < 1."""
    if not 0 < q < 1:
        raise ValueError(f"a quantile lies between 0 and 1, not at {q}")
    return rows.groupBy("threat_id").agg(F.percentile(value, F.lit(q)).alias("threshold"))


def transition_rows(rows: DataFrame, q: float, k: int, features: tuple[str, ...], value: str = "severity") -> DataFrame:
    """Rows below their threshold with known features and a whole future, and whether any of the
    next ``k`` steps reaches it."""
    ahead = by_time().rowsBetween(1, k)
    made = rows.withColumns({"_known": F.count(value).over(ahead), "_most": F.max(value).over(ahead)})
    made = made.join(escalation_threshold(rows, q, value), "threat_id")
    ready = (F.col(value) < F.col("threshold")) & (F.col("_known") == k)
    for f in features:
        ready = ready & F.col(f).isNotNull()
    return made.where(ready).withColumn("label", (F.col("_most") >= F.col("threshold")).cast("int")).drop("_known", "_most")


def cadence_hours(rows: DataFrame) -> DataFrame:
    """Median step of every series; NULL with fewer than two rows or a step that does not go forward."""
    secs = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    gaps = rows.withColumn("gap", (secs - F.lag(secs).over(by_time())) / 3600.0)
    return gaps.groupBy("threat_id").agg(F.when(F.min("gap") > 0, F.percentile("gap", F.lit(0.5))).alias("cadence_hours"))


# Fixed wording and cuts of the summary: hPa in three hours, 1/s, mm in three hours, K.
_FALLS = ((-3.0, "rapid 3-hour pressure falls (most recent: %+.1f hPa/3h)"), (-1.5, "steady pressure falls (most recent: %+.1f hPa/3h)"))
_RISE = (1.5, "pressure rises (most recent: %+.1f hPa/3h), suggesting weakening")
_STEADY = "near-steady pressure (most recent: %+.1f hPa/3h)"
_CONVERGES = ((-5e-5, "strong low-level wind convergence (div: %.2e s⁻¹)"), (-1e-5, "moderate low-level convergence (div: %.2e s⁻¹)"))
_RAIN = ((10.0, "intense precipitation (%.1f mm/3h at centroid)"), (2.0, "moderate precipitation (%.1f mm/3h at centroid)"))
_WARM, _COLD = "positive surface temperature anomaly (%+.1f K)", "negative surface temperature anomaly (%+.1f K)"
_NOTHING, _ONE, _MORE = "No significant precursor signal detected in the analysed window.", "Evolution driven by %s.", "Evolution driven by %s, with supporting signals: %s."


def explanations(rows: DataFrame, key: str = "threat_id", time: str = "timestamp") -> DataFrame:
    """(key, summary): what the last known value of each precursor says, in one sentence.

    Reads pressure_tendency_3h_hpa, wind_divergence_s1, precipitation_rate_mm3h and t2m_anomaly_k; one that is
    never known, or that crosses no cut, says nothing (but pressure always says something). The last
    values are taken by an aggregate, so a long history is not put in order.
    """
    names = {"p": "pressure_tendency_3h_hpa", "d": "wind_divergence_s1", "r": "precipitation_rate_mm3h", "t": "t2m_anomaly_k"}
    last = rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(n) for n, c in names.items()])
    p, d, r, t = (F.col(n) for n in names)
    say = lambda text, x: F.format_string(text, x)
    drivers = F.array_compact(F.array(
        F.when(p < _FALLS[0][0], say(_FALLS[0][1], p)).when(p < _FALLS[1][0], say(_FALLS[1][1], p)).when(p > _RISE[0], say(_RISE[1], p)).when(p.isNotNull(), say(_STEADY, p)),
        F.when(d < _CONVERGES[0][0], say(_CONVERGES[0][1], d)).when(d < _CONVERGES[1][0], say(_CONVERGES[1][1], d)),
        F.when(r > _RAIN[0][0], say(_RAIN[0][1], r)).when(r > _RAIN[1][0], say(_RAIN[1][1], r)),
        F.when(t > 2.0, say(_WARM, t)).when(t < -2.0, say(_COLD, t)),
    ))
    said = last.withColumn("drivers", drivers)
    rest = F.array_join(F.slice("drivers", F.lit(2), F.greatest(F.size("drivers") - 1, F.lit(0))), "; ")
    n = F.size("drivers")
    return said.select(key, F.when(n == 0, _NOTHING).when(n == 1, say(_ONE, F.get("drivers", F.lit(0)))).otherwise(F.format_string(_MORE, F.get("drivers", F.lit(0)), rest)).alias("summary"))
