"""Metrics that are NULL where they are undefined, never 0 or NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .quantiles import exact_quantiles
from .scans import Axis, running_sum

LEAST_COMMON = 0.5


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def field_errors(pairs: DataFrame) -> DataFrame:
    """RMSE, MAE and bias of (p, r) over cells that both have; NULL below half of the cells."""
    d = F.col("p") - F.col("r")
    share = F.avg((F.col("p").isNotNull() & F.col("r").isNotNull()).cast("double"))
    ok = lambda x: F.when(share >= LEAST_COMMON, x)
    return pairs.agg(share.alias("valid_fraction"), ok(F.sqrt(F.avg(d * d))).alias("rmse"), ok(F.avg(F.abs(d))).alias("mae"), ok(F.avg(d)).alias("bias"))


def peak_preservation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(ratio(F.max("p"), F.max("r")).alias("peak_preservation"))


def percentile_error(pairs: DataFrame) -> DataFrame:
    """Differences of the 95 % and 99 % percentiles of p and r, and the mean of those that can be computed: one row.

    The percentiles are exact and are found when this is called (see quantiles.exact_quantiles).
    """
    both = kept(pairs.select("p", "r"))
    p, r = (exact_quantiles(both, c, (0.95, 0.99)) for c in ("p", "r"))
    e = [None if x is None or y is None else abs(x - y) for x, y in zip(p, r, strict=True)]
    known = [x for x in e if x is not None]
    mean = sum(known) / len(known) if known else None
    made = pairs.sparkSession.range(1)
    return made.select(*[F.lit(v).cast("double").alias(n) for n, v in (("p95_error", e[0]), ("p99_error", e[1]), ("mean_error", mean))])


def overlap(pairs: DataFrame, threshold: float) -> DataFrame:
    """IoU, Dice and exceedance shares of values at or above the threshold; NULL when neither has any."""
    a, b = (F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in ("p", "r"))
    n = lambda x: F.sum(x.cast("double"))
    both, either = n(a & b), n(a | b)
    return pairs.agg(
        ratio(both, either).alias("iou"), ratio(2 * both, n(a) + n(b)).alias("dice"),
        F.avg(a.cast("double")).alias("predicted_share"), F.avg(b.cast("double")).alias("reference_share"),
        (F.avg(a.cast("double")) - F.avg(b.cast("double"))).alias("exceedance_change"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and rates of boolean ``predicted`` against ``reference``."""
    p, r = F.col("predicted"), F.col("reference")
    c = rows.agg(*[F.sum(x.cast("long")).alias(n) for n, x in (("tp", p & r), ("fp", p & ~r), ("fn", ~p & r), ("tn", ~p & ~r))])
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (1 - precision).alias("false_alarm"), (1 - recall).alias("miss"))


def brier_skill(scores: DataFrame, *group: str) -> DataFrame:
    b = scores.groupBy(*group).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(F.col("y").cast("double")).alias("base_rate"))
    ref = F.col("base_rate") * (1 - F.col("base_rate"))
    return b.select(*group, "brier", "base_rate", F.when(ref > 0, 1 - F.col("brier") / ref).alias("skill"))


def roc_auc(scores: DataFrame, bins: int = 1024, group: tuple[str, ...] = ()) -> DataFrame:
    """By average ranks, for each group; NULL with one class.

    Equal scores are summed first. Ranks then come in two steps, so that no window holds more than
    a bin's scores: rows before a bin (a table of ``bins`` rows a group), and before a score inside its bin.
    """
    by_p = scores.groupBy(*group, "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    axis = Axis(("p",), group, F.least(F.greatest(F.floor(F.col("p") * bins), F.lit(0)), F.lit(bins - 1)))
    ranked = running_sum(by_p, axis, F.col("n"), "below", before=True)
    ranked = ranked.withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*group).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("a"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("b"))
    return s.select(*group, F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))).alias("auc"))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) for every bin; empty bins stay, with NULLs."""
    binned = scores.withColumn("bin", F.least(F.floor(F.col("p") * bins) + 1, F.lit(bins)).cast("int"))
    got = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    every = scores.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def expected_calibration_error(scores: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(scores, bins)
    return r.agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))), F.sum("n")).alias("ece"))


def verdict(value: Column, good: Column, fair: Column, higher: bool) -> Column:
    """PASS, DEGRADE or SUPPRESS; NULL without a value, without thresholds or with them in a wrong order."""
    order = good >= fair if higher else good <= fair
    at = lambda t: value >= t if higher else value <= t
    return F.when(value.isNull() | good.isNull() | fair.isNull() | ~order, None).when(at(good), "PASS").when(at(fair), "DEGRADE").otherwise("SUPPRESS")


#: Metrics by the direction in which they are better.
HIGHER_IS_BETTER = ("iou", "dice", "precision", "recall", "f1", "skill", "auc", "peak_preservation", "continuity", "id_consistency")
LOWER_IS_BETTER = ("rmse", "mae", "brier", "ece", "false_alarm", "miss", "mean_km", "rms_km")


def gate(metric: Column, value: Column, has_table: Column, good: Column, fair: Column, own_good: Column | None = None, own_fair: Column | None = None) -> Column:
    """Verdict of a stage: SUPPRESS without a metric table; NULL for a metric of unknown direction, for
    thresholds that are missing or in a wrong order, and without a value. Thresholds of the stage itself
    (0.0 is one) come before the shared ones."""
    good = good if own_good is None else F.coalesce(own_good, good)
    fair = fair if own_fair is None else F.coalesce(own_fair, fair)
    up, down = verdict(value, good, fair, True), verdict(value, good, fair, False)
    return F.when(~has_table, "SUPPRESS").when(metric.isin(*HIGHER_IS_BETTER), up).when(metric.isin(*LOWER_IS_BETTER), down)


def overall(verdicts: DataFrame) -> DataFrame:
    """The worst verdict; NULL if one is undecided."""
    rank = F.when(F.col("verdict") == "PASS", 0).when(F.col("verdict") == "DEGRADE", 1).otherwise(2)
    return verdicts.agg(F.when(F.count("verdict") == F.count(F.lit(1)), F.max_by("verdict", rank)).alias("overall"))
