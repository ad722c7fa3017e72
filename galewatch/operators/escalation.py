"""Escalation probabilities: a standardised logistic model, when it may be fitted and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS, LEAST_POSITIVE, LEAST_NEGATIVE = 20, 5, 2


def publishable(skill: Column, auc: Column) -> Column:
    """Better than the base rate and than chance; a missing metric blocks."""
    return F.coalesce((skill > 0) & (auc > 0.5), F.lit(False))


def refusals(rows: DataFrame) -> DataFrame:
    """Why a series cannot be fitted (NULL if it can)."""
    n, pos = F.count(F.lit(1)), F.sum(F.col("label").cast("long"))
    reason = F.when(n < LEAST_ROWS, "too few rows").when(pos < LEAST_POSITIVE, "too few positives").when(n - pos < LEAST_NEGATIVE, "too few negatives")
    return rows.groupBy("threat_id").agg(n.alias("rows"), pos.alias("positives"), reason.alias("refused"))


def fit_escalation(rows: DataFrame, features: list[str], scored: DataFrame | None = None) -> DataFrame:
    """Logistic model over the rows of all series (population-standardised, L2 of strength 1): threat_id,
    timestamp, label, probability of ``scored`` (of the rows themselves, without it). Without both classes
    every probability is the base rate."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("base"), *[f(c).alias(f"{p}_{c}") for c in features for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"] or stats["base"] in (0.0, 1.0):
        return (rows if scored is None else scored).select("threat_id", "timestamp", "label", F.lit(stats["base"]).cast("double").alias("probability"))
    def scaled(df: DataFrame) -> DataFrame:
        made = df.select("threat_id", "timestamp", "label", *[((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in features])
        return VectorAssembler(inputCols=features, outputCol="x").transform(made)

    data = scaled(rows)
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / stats["n"], elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    return model.transform(data if scored is None else scaled(scored)).select("threat_id", "timestamp", "label", vector_to_array("probability")[1].alias("probability"))
