"""Structured Streaming: windowed frames and anomalies against a static climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.meteo import z_score

def frame_means(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Cell means of tumbling windows; rows later than ``late`` behind the newest are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.pmod("user_id", F.lit(66)).alias("node_id"))
        .agg(F.avg("value").alias("value"))
        .select(F.col("window.start").alias("valid_time"), "node_id", "value")
    )


def streamed_anomalies(frames: DataFrame, clim: DataFrame) -> DataFrame:
    """z of streamed cell means against a static table of node_id, mean, std."""
    return frames.join(clim, "node_id").withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std")))
