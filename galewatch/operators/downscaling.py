"""Three ways to refine a coarse field, scored on columns that no fit has seen: as interpolated, after a ridge
filter of its neighbourhood, and after a quantile map of the filter's output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from . import grids
from .alignment import axis_split, hold_out
from .horizons import alpha_sweep, dot, floored
from .metrics import ratio

#: Share of held-out cells that must have a reference, and of training columns that fit while the rest choose the penalty.
LEAST_COVERAGE, INNER = 0.5, 0.85
METHODS = ("interpolated", "ridge", "ridge_mapped")


@dataclass(frozen=True)
class Evaluation:
    """status is scored or not_scoreable (then with a reason, and nothing else); scores has a row a method, steps one
    for each time and method, sweep one for each penalty."""

    status: str
    reason: str | None = None
    alpha: float | None = None
    scores: DataFrame | None = None
    steps: DataFrame | None = None
    sweep: DataFrame | None = None


def _errors() -> list:
    e = F.col("prediction") - F.col("r")
    return [
        F.count(e).alias("cells"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        ratio(F.max("prediction"), F.max("r")).alias("peak_preservation"),
    ]


def refusal(pairs: DataFrame) -> str | None:
    """Why a sequence of pairs (p, r, held_out) cannot be scored, or None. One pass."""
    # of equal peaks one with a reference counts
    top = F.when(F.col("p").isNotNull(), F.struct("p", F.col("r").isNotNull()))
    held = F.avg(F.when(F.col("held_out"), F.col("r").isNotNull().cast("double")))
    got = pairs.agg(F.max_by(F.col("r").isNull(), top).alias("lost"), F.count("p").alias("known"), held.alias("held")).first()
    if not got["known"]:
        return "the coarse field has no value"
    if got["lost"]:
        return "the coarse field peaks where the reference has no value"
    if got["held"] is None or got["held"] < LEAST_COVERAGE:
        return f"{got['held'] or 0:.1%} of the held-out cells have a reference, less than {LEAST_COVERAGE:.0%}"
    return None


def evaluate(
    pairs: DataFrame, radius: int = 1, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0), share: float = 0.3, knots: int = 101, variable: str = "t2m", time: str = "valid_time"
) -> Evaluation:
    """Scores of the three methods on the last ``share`` of the columns j of pairs (time, i, j, p, r).

    p is the interpolated field, r the reference. The penalty is chosen on the last columns of the training part,
    the filter is then fitted on all of it, and the quantile map on the filter's output there. A sequence
    whose peak lies outside the reference, or whose held-out columns are mostly unknown, is not scored.
    ContractError where the hold-out leaves one side empty.
    """
    split = kept(hold_out(pairs.select(time, "i", "j", "p", "r"), "j", share))
    reason = refusal(split)
    if reason:
        return Evaluation("not_scoreable", reason)
    width = 2 + (2 * radius + 1) ** 2
    features = grids.filter_features(split.where("p is not null").select(time, "i", "j", F.col("p").alias("value")), radius, time)
    whole = features.where((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull()))
    parts = axis_split(split.where("not held_out").select("j"), "j", INNER)
    rows = kept(split.where("r is not null").join(whole, [time, "i", "j"]).withColumn("y", F.col("r")))
    inner = rows.where("not held_out").join(parts, "j")
    sweep = kept(alpha_sweep(inner.where("part = 'train'"), inner.where("part = 'validate'"), width, alphas))
    alpha = sweep.where("chosen").first()["alpha"]
    w = grids.ridge(grids.normal_equations(rows.where("not held_out").select("x", "y"), width), width, alpha)
    fitted = rows.withColumn("ridge", floored(dot(F.col("x"), w), variable))
    map_ = grids.quantile_knots(fitted.where("not held_out").select(F.col("ridge").alias("x"), "y"), knots)
    held = fitted.where("held_out").select(time, "i", "j", "r", F.col("p").alias("interpolated"), "ridge", F.col("ridge").alias("x"))
    mapped = grids.apply_quantile_map(held, map_).withColumn("ridge_mapped", floored(F.col("mapped"), variable))
    long = kept(mapped.unpivot([time, "i", "j", "r"], list(METHODS), "method", "prediction"))
    return Evaluation("scored", None, alpha, long.groupBy("method").agg(*_errors()), long.groupBy(time, "method").agg(*_errors()), sweep)
