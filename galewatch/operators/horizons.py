"""Forecasts over several horizons, out-of-fold probabilities, and the choice of parameters by held-out error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept
from . import grids
from .escalation import fit_escalation
from .mesh import histories
from .scans import Axis, numbered

MOST_STEPS = 24


def steps_ahead(horizon_hours: Column, step_hours: Column) -> Column:
    """Whole steps of a horizon, ties to the even number, at least one; NULL for a step that is not positive."""
    return F.when(step_hours > 0, F.greatest(F.lit(1), F.bround(horizon_hours / step_hours).cast("int")))


def horizon_frames(values: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Persistence at every horizon, stacked: node_id, valid_time, horizon, prediction, reference."""
    w = Window.partitionBy("node_id").orderBy("valid_time")
    every = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("value", h).over(w).alias("reference")) for h in horizons])
    ahead = values.select("node_id", "valid_time", F.col("value").alias("prediction"), every.alias("every"))
    return ahead.select("node_id", "valid_time", "prediction", F.explode("every").alias("h")).select("node_id", "valid_time", "h.horizon", "prediction", "h.reference").where("reference is not null")


def lag_rows(values: DataFrame, lags: int, ahead: int = 1) -> DataFrame:
    """(node_id, valid_time, x, y): 1 and the last ``lags`` values, and the value ``ahead - 1`` steps on."""
    w = Window.partitionBy("node_id").orderBy("valid_time")
    rows = histories(values.withColumn("y", F.lead("value", ahead - 1).over(w)), lags)
    return rows.select("node_id", "valid_time", F.concat(F.array(F.lit(1.0)), "history").alias("x"), "y").where("y is not null")


def dot(x: Column, weights: np.ndarray) -> Column:
    """x * weights, for arrays as long as the weights."""
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def rollout(start: DataFrame, weights: np.ndarray, steps: int) -> DataFrame:
    """Predictions fed back ``steps`` times (at most MOST_STEPS): start has node_id and history, oldest first.

    The first weight is the constant. Returns node_id, step (from 1), prediction.
    """
    if not 1 <= steps <= MOST_STEPS:
        raise ValueError(f"steps must be between 1 and {MOST_STEPS}")
    made = start.select("node_id", "history", F.array().cast("array<double>").alias("out"))
    for _ in range(steps):
        nxt = dot(F.concat(F.array(F.lit(1.0)), "history"), weights)
        made = made.select("node_id", F.concat(F.slice("history", 2, len(weights) - 2), F.array(nxt)).alias("history"), F.array_append("out", nxt).alias("out"))
    return made.select("node_id", F.posexplode("out").alias("k", "prediction")).select("node_id", (F.col("k") + 1).alias("step"), "prediction")


def skill_table(rows: DataFrame, feature: str, reference: str, methods: tuple[str, ...], baseline: str) -> DataFrame:
    """(feature, method, rmse, mae, improvement): improvement in percent over the baseline's RMSE, 0 where that is 0."""
    long = rows.unpivot([feature, reference], list(methods), "method", "prediction")
    e = F.col("prediction") - F.col(reference)
    scores = long.groupBy(feature, "method").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    base = F.max(F.when(F.col("method") == baseline, F.col("rmse"))).over(Window.partitionBy(feature))
    return scores.withColumn("_b", base).withColumn("improvement", F.when(F.col("_b") == 0, 0.0).otherwise(100 * (1 - F.col("rmse") / F.col("_b")))).drop("_b")


def alpha_sweep(train: DataFrame, held: DataFrame, width: int, alphas: tuple[float, ...]) -> DataFrame:
    """Held-out RMSE of ridge weights for every penalty (order, alpha, rmse, chosen) from rows (x, y).

    The normal equations are summed once, all penalties are scored in one pass, and the first of equally
    good ones is chosen.
    """
    gram = grids.gram(grids.normal_equations(train, width), width)
    weights = [grids.solve_ridge(gram, a) for a in alphas]
    errors = [F.sqrt(F.avg(F.pow(dot(F.col("x"), w) - F.col("y"), 2))) for w in weights]
    rows = held.where("y is not null").agg(F.array(*[F.struct(F.lit(k).alias("order"), F.lit(float(a)).alias("alpha"), e.alias("rmse")) for k, (a, e) in enumerate(zip(alphas, errors, strict=True))]).alias("r"))
    best = F.array_min(F.transform("r", lambda s: F.struct(s["rmse"], s["order"])))["order"]
    return rows.select(F.explode("r").alias("s"), best.alias("best")).select("s.order", "s.alpha", "s.rmse", (F.col("s.order") == F.col("best")).alias("chosen"))


def fit_quality(sums: DataFrame, width: int, alpha: float = 0.0) -> tuple[float, float]:
    """Residual and total sum of squares of a ridge fit, from its normal equations alone."""
    gram = grids.gram(sums, width)
    w = grids.solve_ridge(gram, alpha)
    yy, xy, xx, n = gram[width, width], gram[:width, width], gram[:width, :width], gram[0, 0]
    return float(yy - 2 * w @ xy + w @ xx @ w), float(yy - gram[0, width] ** 2 / n)


def radius_sweep(field: DataFrame, target: DataFrame, radii: tuple[int, ...], alpha: float) -> DataFrame:
    """RMSE of neighbourhood filters of several radii on every fourth column, fitted on the others: radius, rmse.

    The widest neighbourhood is gathered once; smaller ones are taken out of it.
    """
    widest = max(radii)
    rows = kept(grids.filter_features(field, widest).join(target.select("i", "j", F.col("value").alias("y")), ["i", "j"]))
    errors = []
    for r in radii:
        width = 2 + (2 * r + 1) ** 2
        own = grids.within(F.col("x"), widest, r)
        w = grids.ridge(grids.normal_equations(rows.where("j % 4 <> 3").select(own.alias("x"), "y"), width), width, alpha)
        errors.append(F.struct(F.lit(r).alias("radius"), F.sqrt(F.avg(F.pow(dot(own, w) - F.col("y"), 2))).alias("rmse")))
    return rows.where("j % 4 = 3").agg(F.array(*errors).alias("e")).select(F.inline("e"))


def floored(prediction: Column, variable: str) -> Column:
    """Rain is never below zero; other variables are as predicted."""
    return F.greatest(prediction, F.lit(0.0)) if variable == "tp" else prediction


def stratified_folds(rows: DataFrame, folds: int, order: list[str], label: str = "label", block: Column | None = None) -> DataFrame:
    """Add fold (0 to folds - 1): classes spread evenly, rows of a class in their order, without shuffling.

    Labels sorted by class are dealt round-robin, which fixes how many rows of each class a fold has; each
    class's rows then fill its folds one after the other. The class of the first row comes first. Places in a
    class are counted by blocks of the order (the values of its first column, and years or thousands of the
    second, unless ``block`` names others), so no window holds a class.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    if not counts:
        return rows.withColumn("fold", F.lit(0))
    first = rows.agg(F.min_by(label, F.struct(*order)).alias("l")).first()["l"]
    bounds, at = {}, 0
    for c in sorted(counts, key=lambda c: (c != first, c)):
        size = [(at + counts[c] - 1 - f) // folds - (at - 1 - f) // folds for f in range(folds)]
        bounds[c], at = np.cumsum(size).tolist(), at + counts[c]
    if block is None:
        dated = lambda c: isinstance(rows.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        numeric = lambda c: isinstance(rows.schema[c].dataType, T.NumericType)
        second = [(F.year(c) if dated(c) else F.floor(F.col(c) / 1000)).alias("b") for c in order[1:2] if dated(c) or numeric(c)]
        block = F.struct(F.col(order[0]).alias("a"), *second)
    placed = numbered(rows, Axis(tuple(order), (label,), block), "_k")
    fold = F.coalesce(*[F.when(F.col(label) == c, F.size(F.filter(F.array(*map(F.lit, b)), _below))) for c, b in bounds.items()])
    return placed.withColumn("fold", fold).drop("_k")


def _below(bound: Column) -> Column:
    return bound < F.col("_k")


def out_of_fold(rows: DataFrame, features: list[str], most_folds: int = 5) -> DataFrame:
    """Probabilities of rows from models that have not seen them: threat_id, timestamp, label, fold, probability.

    As many folds as the rarer class has rows, at most ``most_folds``; with fewer than two the model's own
    rows are scored.
    """
    rows = kept(rows)
    sizes = rows.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).first()
    folds = int(min(most_folds, sizes["a"] or 0, sizes["b"] or 0))
    if folds < 2:
        return fit_escalation(rows, features).withColumn("fold", F.lit(0))
    dealt = kept(stratified_folds(rows, folds, ["threat_id", "timestamp"]))
    out = None
    for f in range(folds):
        one = fit_escalation(dealt.where(F.col("fold") != f), features, dealt.where(F.col("fold") == f)).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out
