"""Mesh graphs: nodes, edges, smoothing, histories and skill against persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(cells: DataFrame) -> DataFrame:
    """Distinct positions with dense ids by latitude and longitude."""
    spots = cells.select("latitude", "longitude").distinct()
    return spots.select((F.row_number().over(Window.orderBy("latitude", "longitude")) - 1).cast("long").alias("node_id"), "latitude", "longitude")


def edges(mesh: DataFrame, dlat: float = 0.5, dlon: float = 1.0) -> DataFrame:
    """Rook neighbours in both directions, matched on rounded whole-number keys; w is 1 / distance."""
    key = lambda lat, lon: (F.round(lat * 10_000).cast("long"), F.round(lon * 10_000).cast("long"))
    a, b = key(F.col("latitude"), F.col("longitude"))
    there = mesh.select(F.col("node_id").alias("dst"), a.alias("ka"), b.alias("kb"))
    shifts = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((dlat, 0.0), (-dlat, 0.0), (0.0, dlon), (0.0, -dlon))])
    here = mesh.select(F.col("node_id").alias("src"), "latitude", "longitude", F.explode(shifts).alias("s"))
    ka, kb = key(F.col("latitude") + F.col("s.y"), F.col("longitude") + F.col("s.x"))
    here = here.select("src", ka.alias("ka"), kb.alias("kb"), (1 / F.sqrt(F.col("s.y") * F.col("s.y") + F.col("s.x") * F.col("s.x"))).alias("w"))
    return here.join(there, ["ka", "kb"]).select("src", "dst", "w")


def smooth(values: DataFrame, mesh_edges: DataFrame, alpha: float = 0.6) -> DataFrame:
    """alpha * x + (1 - alpha) * A x, A the symmetrically normalised adjacency with self-loops."""
    loops = mesh_edges.select(F.col("src").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w")).distinct()
    every = mesh_edges.select("src", "dst", "w").unionByName(loops)
    degree = every.groupBy("dst").agg(F.sum("w").alias("d"))
    norm = every.join(degree, "dst").join(degree.select(F.col("dst").alias("src"), F.col("d").alias("ds")), "src").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("ds"))).alias("a"))
    moved = values.select("valid_time", F.col("node_id").alias("src"), "value").join(norm, "src").groupBy("valid_time", F.col("dst").alias("node_id")).agg(F.sum(F.col("a") * F.col("value")).alias("ax"))
    return values.select("valid_time", "node_id", "value").join(moved, ["valid_time", "node_id"]).withColumn("smoothed", alpha * F.col("value") + (1 - alpha) * F.col("ax"))


def histories(values: DataFrame, length: int = 6) -> DataFrame:
    """Whole histories of ``length`` steps before each step."""
    w = Window.partitionBy("node_id").orderBy("valid_time")
    past = F.collect_list("value").over(w.rowsBetween(-length, -1))
    return values.withColumn("history", past).where(F.size("history") == length)


def persistence(values: DataFrame) -> DataFrame:
    return values.withColumn("previous", F.lag("value").over(Window.partitionBy("node_id").orderBy("valid_time")))
