"""What a serving layer asks: lists, lookups, alerts, health and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("moderate", "severe", "extreme")
MOST_THREATS, ALERT_RADIUS = 500, 5.0


def severity_rank(severity: Column) -> Column:
    """1 to 3 from moderate to extreme, 0 for anything else."""
    return F.coalesce(*[F.when(F.lower(severity) == s, k + 1) for k, s in enumerate(RANKS)], F.lit(0))


def threat_list(threats: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """Threats of a severity (all, without one) by id, at most ``limit`` of them (1 to 500)."""
    if not 1 <= limit <= MOST_THREATS:
        raise ValueError(f"limit must be between 1 and {MOST_THREATS}")
    chosen = threats if severity is None else threats.where(F.lower("severity") == severity.lower())
    return chosen.orderBy("threat_id").limit(limit)


def lookup(threats: DataFrame, threat_id: str) -> DataFrame:
    """The threat with an id: one row, or none."""
    return threats.where(F.col("threat_id") == threat_id)


def alerts(threats: DataFrame, floor: str = "moderate") -> DataFrame:
    """Threats at or above a severity, each with how many there are."""
    chosen = threats.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(floor)))
    return chosen.join(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("total"))))  # one row


def tier(z: Column) -> Column:
    return F.when(z >= 4, "severe").when(z >= 3, "moderate").otherwise("low")


def legacy_alerts(cells: DataFrame, severity: str | None = None) -> DataFrame:
    """Cells with their tier and a fixed radius; a wanted severity is matched exactly, it is no floor."""
    made = cells.withColumn("tier", tier(F.col("z"))).withColumn("radius", F.lit(ALERT_RADIUS))
    return made if severity is None else made.where(F.col("tier") == severity)


def strongest(cells: DataFrame, *group: str, time: str = "valid_time") -> DataFrame:
    """The row with the highest z of each group, the earliest of equal ones."""
    w = Window.partitionBy(*group).orderBy(F.desc("z"), time)
    return cells.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def health(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, ok, healthy): whether each stage's table has a row, and whether all do."""
    made = None
    for name, rows in stages.items():
        one = rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("ok")).select(F.lit(name).alias("stage"), "ok")
        made = one if made is None else made.unionByName(one)
    return made.join(F.broadcast(made.agg(F.min("ok").alias("healthy"))))  # one row


def variant(coarse: DataFrame, fine: DataFrame, value: str, *key: str) -> DataFrame:
    """The downscaled value where there is one, else the coarse one; ``downscaled`` says which."""
    both = coarse.join(fine.select(*key, F.col(value).alias("_fine")), list(key), "left")
    return both.withColumn("downscaled", F.col("_fine").isNotNull()).withColumn(value, F.coalesce("_fine", value)).drop("_fine")


def latest_publishable(rows: DataFrame, publishable: DataFrame, time: str = "timestamp") -> DataFrame:
    """The last eligible row of each threat whose model may be published (``publishable``: threat_id, publish)."""
    w = Window.partitionBy("threat_id").orderBy(F.desc(time))
    last = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return last.join(publishable.where("publish").select("threat_id"), "threat_id", "left_semi")


def shortest(rows: DataFrame, horizon: str = "horizon_hours", by: str = "threat_id", tie: str | None = None) -> DataFrame:
    """Of each threat the row with the shortest horizon; of equal ones that with the smallest ``tie``."""
    whole = F.struct(*[c for c in rows.columns if c != by])
    return rows.groupBy(by).agg(F.min_by(whole, F.struct(horizon, tie) if tie else F.col(horizon)).alias("r")).select(by, "r.*")
