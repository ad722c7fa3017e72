"""Fields on grids: regridding, neighbourhoods, differences, ridge filters and quantile maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.meteo import EARTH_M
from .quantiles import exact_quantiles


def _brackets(target: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """Each target coordinate with the two axis points around it; outside the axis it has none."""
    w = Window.orderBy("coord")  # an axis: one row for each grid line
    pairs = axis.select(F.col("coord").alias("lo"), F.lead("coord").over(w).alias("hi"), F.lead("coord", 2).over(w).isNull().alias("last")).where("hi is not null")
    at = F.col(f"{name}_t")
    inside = (at >= F.col("lo")) & ((at < F.col("hi")) | ((at == F.col("hi")) & F.col("last")))
    return target.join(F.broadcast(pairs), inside, "left").select(f"{name}_t", F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))


def bilinear(field: DataFrame, rows: DataFrame, cols: DataFrame, *group: str) -> DataFrame:
    """``field`` (i, j, value) at every (i_t, j_t): NULL outside the domain or where a corner is. With a group (times,
    say) one field for each; all have the same axes."""
    axis = lambda c: field.select(F.col(c).cast("double").alias("coord")).distinct()
    spots = _brackets(rows, axis("i"), "i").join(_brackets(cols, axis("j"), "j"))  # the target grid itself
    u = (F.col("i_t") - F.col("i_lo")) / (F.col("i_hi") - F.col("i_lo"))
    v = (F.col("j_t") - F.col("j_lo")) / (F.col("j_hi") - F.col("j_lo"))
    corners = F.array(*[
        F.struct(F.col(f"i_{a}").alias("i"), F.col(f"j_{b}").alias("j"), ((u if a == "hi" else 1 - u) * (v if b == "hi" else 1 - v)).alias("weight")) for a in ("lo", "hi") for b in ("lo", "hi")
    ])
    # the field is read once for all four corners
    wanted = spots.select("i_t", "j_t", F.explode(corners).alias("c")).select("i_t", "j_t", "c.*")
    wanted = wanted.join(field.select(*group).distinct()) if group else wanted  # the target grid of each time
    cells = field.select(*group, F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"), "value")
    sums = wanted.join(cells, [*group, "i", "j"], "left").groupBy(*group, "i_t", "j_t").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count("value").alias("known"))
    return sums.select(*group, "i_t", "j_t", F.when(F.col("known") == 4, F.col("value")).alias("value"))


def nearest(field: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Value of the nearest grid point (the lower one on ties); NULL outside the domain."""
    axis = lambda c: field.select(F.col(c).cast("double").alias("coord")).distinct()

    def near(target: DataFrame, name: str) -> DataFrame:
        b = _brackets(target, axis(name), name)
        return b.select(f"{name}_t", F.when(F.col(f"{name}_t") - F.col(f"{name}_lo") <= F.col(f"{name}_hi") - F.col(f"{name}_t"), F.col(f"{name}_lo")).otherwise(F.col(f"{name}_hi")).alias(name))

    spots = near(rows, "i").join(near(cols, "j"))
    return spots.join(field.select(F.col("i").cast("double").alias("i"), F.col("j").cast("double").alias("j"), "value"), ["i", "j"], "left").select("i_t", "j_t", "value")


def crop(field: DataFrame, i: tuple[float, float], j: tuple[float, float]) -> DataFrame:
    """Cells inside inclusive ranges, given in either order."""
    return field.where(F.col("i").between(min(i), max(i)) & F.col("j").between(min(j), max(j)))


def neighbourhood(field: DataFrame, radius: int, *group: str) -> DataFrame:
    """(group, i, j, di, dj, value): every cell's neighbours in its group, with the edge repeated beyond it."""
    size = field.agg(F.max("i").alias("top_i"), F.max("j").alias("top_j"))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    wanted = field.select(*group, "i", "j").join(F.broadcast(size)).select("*", F.explode(steps).alias("di")).select("*", F.explode(steps).alias("dj"))  # one row of sizes
    clamp = lambda x, d, top: F.least(F.greatest(F.col(x) + F.col(d), F.lit(0)), F.col(top))
    wanted = wanted.select(*group, "i", "j", "di", "dj", clamp("i", "di", "top_i").alias("ni"), clamp("j", "dj", "top_j").alias("nj"))
    return wanted.join(field.select(*group, F.col("i").alias("ni"), F.col("j").alias("nj"), "value"), [*group, "ni", "nj"]).select(*group, "i", "j", "di", "dj", "value")


def gradients(field: DataFrame) -> DataFrame:
    """Centred differences along i and j, one-sided at the edges."""
    out = field
    for axis, other in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(other).orderBy(axis)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        out = out.withColumn(f"d{axis}", F.coalesce((after - before) / 2, after - F.col("value"), F.col("value") - before))
    return out


def divergence(field: DataFrame, u: str = "u", v: str = "v", *group: str) -> DataFrame:
    """Add divergence in 1/s of winds in m/s on a regular grid (latitude, longitude): du/dx + dv/dy, positive v to the north.

    Differences are centred, one-sided at the edges; metres of a degree of longitude are those of the grid's middle
    latitude. NULL where a neighbour that is needed is missing; with one row or column a step of 0.25 is taken.
    """
    ends = field.agg(*[f(c).alias(f"_{n}_{c}") for c in ("latitude", "longitude") for n, f in (("low", F.min), ("high", F.max), ("n", F.count_distinct))])
    middle = F.radians((F.col("_low_latitude") + F.col("_high_latitude")) / 2)
    made = field.join(F.broadcast(ends))  # one row
    parts = []
    for value, axis, other, metres in ((u, "longitude", "latitude", F.cos(middle)), (v, "latitude", "longitude", F.lit(1.0))):
        step = F.when(F.col(f"_n_{axis}") > 1, (F.col(f"_high_{axis}") - F.col(f"_low_{axis}")) / (F.col(f"_n_{axis}") - 1)).otherwise(0.25)
        w = Window.partitionBy(*group, other).orderBy(axis)
        near = lambda shift, sign, value=value, axis=axis, step=step, w=w: F.when(F.abs(shift(axis).over(w) - F.col(axis) - sign * step) < step / 2, shift(value).over(w))
        before, after, here = near(F.lag, -1), near(F.lead, 1), F.col(value)
        first, last = (F.abs(F.col(axis) - F.col(f"_{e}_{axis}")) < step / 2 for e in ("low", "high"))
        index = F.when(first, after - here).when(last, here - before).otherwise((after - before) / 2)
        made = made.withColumn(f"_d{axis}", index / (step * metres * (math.pi / 180 * EARTH_M)))
        parts.append(F.col(f"_d{axis}"))
    return made.withColumn("divergence", parts[0] + parts[1]).drop(*[c for c in made.columns if c.startswith("_")])


def filter_features(field: DataFrame, radius: int, *group: str) -> DataFrame:
    """(group, i, j, x): features 1, the centre, and each neighbour less the centre."""
    around = neighbourhood(field, radius, *group).join(field.select(*group, "i", "j", F.col("value").alias("centre")), [*group, "i", "j"])
    parts = F.array_sort(F.collect_list(F.struct("di", "dj", (F.col("value") - F.col("centre")).alias("d"))))
    got = around.groupBy(*group, "i", "j").agg(F.first("centre").alias("centre"), parts.alias("p"))
    return got.select(*group, "i", "j", F.concat(F.array(F.lit(1.0), F.col("centre")), F.transform("p", lambda s: s["d"])).alias("x"))


def within(x: Column, radius: int, smaller: int) -> Column:
    """Features of a smaller radius out of those of ``radius``."""
    side = 2 * radius + 1
    places = [1, 2] + [3 + i * side + j for i in range(side) for j in range(side) if max(abs(i - radius), abs(j - radius)) <= smaller]
    return F.transform(F.array(*map(F.lit, places)), lambda k: F.element_at(x, k))


def normal_equations(rows: DataFrame, width: int) -> DataFrame:
    """Sums of x_a * x_b (a, b, s) of rows (x, y), where y is number ``width``: a partial sum for each
    task first, so what is shuffled does not depend on the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for pdf in batches:
            m = np.column_stack([np.vstack(pdf["x"]), pdf["y"]]) if len(pdf) else np.zeros((0, width + 1))
            total += m.T @ m
        a, b = np.indices(total.shape)
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "s": total.ravel()})

    return rows.where("y is not null").mapInPandas(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def gram(sums: DataFrame, width: int) -> np.ndarray:
    """Normal equations as a matrix: (width + 1) ** 2 numbers."""
    made = np.zeros((width + 1, width + 1))
    for r in sums.collect():
        made[r["a"], r["b"]] = r["s"]
    return made


def solve_ridge(sums: np.ndarray, alpha: float) -> np.ndarray:
    """Weights from a matrix of normal equations; the intercept is not penalised."""
    width = len(sums) - 1
    penalty = alpha * np.eye(width)
    penalty[0, 0] = 0
    return np.linalg.solve(sums[:width, :width] + penalty + 1e-9 * np.diag(np.arange(width) > 0), sums[:width, width])


def ridge(sums: DataFrame, width: int, alpha: float) -> np.ndarray:
    return solve_ridge(gram(sums, width), alpha)


def quantile_knots(pairs: DataFrame, knots: int = 201) -> DataFrame:
    """(k, x, y): exact quantiles of prediction and reference; y never falls, repeated x are dropped. ``pairs`` is
    scanned a few times: give it as a table."""
    at = [i / (knots - 1) for i in range(knots)]
    xs, ys = (exact_quantiles(pairs, c, at) for c in ("x", "y"))
    made, high = [], None
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        high = y if high is None else high if y is None else max(high, y)
        if x is not None and (k == 0 or x > xs[k - 1]):
            made.append((k, x, high))
    return pairs.sparkSession.createDataFrame(made, "k int, x double, y double")  # a row a knot


def apply_quantile_map(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """Add ``mapped``: piecewise linear between knots, constant beyond the first and last.

    The knots (a few hundred rows) are constants of the plan; each value finds its span by binary search.
    """
    got = sorted((r["x"], r["y"]) for r in knots.collect())  # a row a knot
    if not got:
        return rows.withColumn("mapped", F.lit(None).cast("double"))
    xs, ys = [x for x, _ in got], [y for _, y in got]
    cut = Bucketizer(splits=[-math.inf, *xs, math.inf], inputCol="x", outputCol="_span", handleInvalid="keep").transform(rows)
    k = F.col("_span").cast("int")
    at = lambda values, i: F.get(F.array(*[F.lit(float(v)) for v in values]), i)
    x0, x1, y0, y1 = at(xs, k - 1), at(xs, k), at(ys, k - 1), at(ys, k)
    line = y0 + (F.col("x") - x0) * (y1 - y0) / (x1 - x0)
    value = F.when(F.col("x").isNull() | F.isnan("x"), None).when(k < 1, ys[0]).when(k >= len(xs), ys[-1]).otherwise(line)
    return cut.withColumn("mapped", value).drop("_span")
