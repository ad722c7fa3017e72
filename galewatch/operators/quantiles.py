"""Exact quantiles of large columns: histograms that close in on the ranks, and a sort of the last bucket only.

No aggregate holds more than a count, a minimum and a maximum for each bucket. What the driver sees are the
borders and counts of the buckets, a few for each wanted quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.meteo import finite
from ..sources.scratch import kept

#: Rows of a bucket that are put in order, at most; a larger one is cut again.
LIMIT = 1_000_000
#: Width of a cut around a rank, as a share of the bucket's rows.
CLOSE = 1e-3


def _cut(rows: DataFrame, edges: list[float]) -> DataFrame:
    """Add bucket: 0 below the first edge, 1 from there to below the second, and so on."""
    if not edges:
        return rows.withColumn("bucket", F.lit(0.0))
    made = rows.withColumn("_x", F.col("x") + F.lit(0.0))  # -0.0 lies at 0.0
    return Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_x", outputCol="bucket").transform(made).drop("_x")


def _histogram(rows: DataFrame, edges: list[float]) -> dict[int, tuple[int, float, float]]:
    """bucket: (rows, least, most); as many entries as edges and one more."""
    got = _cut(rows, edges).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
    return {int(r["bucket"]): (r["n"], r["a"], r["b"]) for r in got}


def exact_quantiles(rows: DataFrame, column: str, at: Sequence[float], limit: int = LIMIT) -> list[float | None]:
    """The quantiles ``at`` (0 to 1) of the known values of a column, interpolated linearly between ranks; None
    without a known value. NaN and infinities are unknown, as everywhere.

    Each pass counts the rows between borders and keeps the buckets in which a wanted rank falls. Borders come
    from approximate quantiles near the ranks, but only the counts decide, so the result is exact. A
    value with many ties gets a bucket of its own.
    """
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles lie between 0 and 1")
    values = rows.select(finite(F.col(column).cast("double")).alias("x")).where("x is not null")
    edges: list[float] = []
    while True:
        counts = _histogram(values, edges)
        total = sum(n for n, _, _ in counts.values())
        if not total:
            return [None] * len(at)
        ranks = sorted({r for q in at for r in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
        before, wanted = 0, {}
        for b in sorted(counts):
            n = counts[b][0]
            inside = [r - before for r in ranks if before <= r < before + n]
            if inside:
                wanted[b] = (before, inside)
            before += n
        large = [b for b in wanted if counts[b][0] > limit and counts[b][1] < counts[b][2]]
        if not large:
            break
        if not edges:
            values = kept(values)  # what is scanned again and again is one column of its own
        fresh = set()
        for b in large:
            n, low, high = counts[b]
            near = {min(max((r + d * n * CLOSE) / n, 0.0), 1.0) for r in wanted[b][1] for d in (-2, 2)}
            part = values.where(F.col("x").between(low, high))
            fresh |= {e for x in part.approxQuantile("x", sorted(near), CLOSE) for e in (x, math.nextafter(x, math.inf))}
            fresh |= {high}  # at the least the largest value is parted from the others
        edges = sorted({e + 0.0 for e in fresh if math.isfinite(e)} | set(edges))
    found: dict[int, float] = {before + r: counts[b][1] for b, (before, inside) in wanted.items() for r in inside if counts[b][1] == counts[b][2]}
    left = {b: w for b, w in wanted.items() if counts[b][1] < counts[b][2]}
    if left:
        some = _cut(values, edges).where(F.col("bucket").isin(*[float(b) for b in left])).groupBy("bucket", "x").agg(F.count(F.lit(1)).alias("n"))
        end = F.sum("n").over(Window.partitionBy("bucket").orderBy("x"))  # values of one bucket, at most ``limit``
        ranked = some.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
        hit = None
        for b, (_, inside) in left.items():
            for r in inside:
                one = (F.col("bucket") == float(b)) & (F.col("start") <= r) & (F.col("end") > r)
                hit = one if hit is None else hit | one
        for row in ranked.where(hit).collect():  # a row a rank
            before, inside = left[int(row["bucket"])]
            found |= {before + r: row["x"] for r in inside if row["start"] <= r < row["end"]}
    out = []
    for q in at:
        place = q * (total - 1)
        low, high = math.floor(place), math.ceil(place)
        out.append(found[low] if low == high or found[low] == found[high] else (high - place) * found[low] + (place - low) * found[high])
    return out
