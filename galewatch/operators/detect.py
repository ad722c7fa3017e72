"""Climatology, standardised anomalies, extreme cells, regions and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_area_km2
from ..functions.meteo import z_score
from ..sources.scratch import kept
from .components import connected
from .contracts import ContractError
from .scans import Axis, long_blocks, numbered, running_sum, with_neighbour

Z_THRESHOLD, LEAST_CELLS, LEAST_COVERAGE = 2.5, 2, 0.9


def climatology(obs: DataFrame, *cell: str) -> DataFrame:
    """Mean, population standard deviation and samples of every cell; a cell of NULLs keeps NULL."""
    return obs.groupBy(*(cell or ("lat_i", "lon_i"))).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def coverage(clim: DataFrame) -> DataFrame:
    """Share of cells with a mean, and whether it is enough to standardise against."""
    share = F.avg(F.col("mean").isNotNull().cast("double"))
    return clim.agg(share.alias("coverage"), (share >= LEAST_COVERAGE).alias("sufficient"), F.count(F.lit(1)).alias("cells"))


def sufficient(clim: DataFrame) -> DataFrame:
    """The climatology itself, if enough of its cells have a mean; else ContractError."""
    got = coverage(clim).first()
    if not got["sufficient"]:
        raise ContractError(f"{got['coverage'] or 0:.1%} of {got['cells']} cells have a mean, less than {LEAST_COVERAGE:.0%}")
    return clim


def anomalies(obs: DataFrame, clim: DataFrame) -> DataFrame:
    """z of every observation. The climatology has a row a cell and is joined as Spark sees fit."""
    return obs.join(clim.select("lat_i", "lon_i", "mean", "std"), ["lat_i", "lon_i"]).withColumn("z", z_score(F.col("value"), F.col("mean"), F.col("std")))


def extremes(z: DataFrame, tail: str = "high", threshold: float = Z_THRESHOLD) -> DataFrame:
    """Cells strictly beyond the threshold on one tail; ``strength`` is positive on either."""
    strength = -F.col("z") if tail == "low" else F.col("z")
    return z.withColumn("strength", strength).where(F.col("strength") > threshold)


def _label(keys: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest key of each 4-connected component: pointers halve their way to it."""
    at = {(r, c): k for k, (r, c) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True))}
    root = np.arange(len(keys))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (r, c), k in at.items():
        for near in ((r + 1, c), (r, c + 1)):
            if near in at:
                a, b = find(k), find(at[near])
                if a != b:
                    lo, hi = (a, b) if keys[a] < keys[b] else (b, a)
                    root[hi] = lo
    return np.array([keys[find(k)] for k in range(len(keys))])


def label_regions(flags: DataFrame, frame: str = "valid_time") -> DataFrame:
    """4-connected regions in every frame: the columns of ``flags`` and label_id, numbered from 1 by
    the first cell (node_id, row by row). A task holds one frame's flagged cells, bounded by the grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root = _label(pdf["node_id"].to_numpy(), pdf["lat_i"].to_numpy(), pdf["lon_i"].to_numpy())
        return pdf.assign(label_id=np.unique(root, return_inverse=True)[1].astype("int64") + 1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flags.schema) + ", label_id long"
    return flags.groupBy(frame).applyInPandas(run, schema)


def label_runs(flags: DataFrame, frame: str = "valid_time") -> DataFrame:
    """The same labels without grouping frames into tasks, for grids that no task can hold.

    Adjoining cells of a row are merged into runs; runs of neighbouring rows that touch are the edges of a
    graph whose components are the regions (see components.connected), so the rounds are logarithmic in the
    longest way through a region, also for a spiral. Rows and frames are scanned by blocks of 256 columns or
    rows: no window grows with the grid.
    """
    row = Axis(("lon_i",), (frame, "lat_i"), long_blocks("lon_i", 256))
    cells = with_neighbour(flags, row, "_west", "lon_i", ahead=False)
    fresh = F.coalesce((F.col("lon_i") > F.col("_west.lon_i") + 1).cast("long"), F.lit(1).cast("long"))
    cells = kept(running_sum(cells.withColumn("_fresh", fresh).drop("_west"), row, F.col("_fresh"), "_run").drop("_fresh"))
    runs = kept(cells.groupBy(frame, "lat_i", "_run").agg(F.min("lon_i").alias("a"), F.max("lon_i").alias("b"), F.min("node_id").alias("node")))
    # a run lists its blocks of columns, so that runs meet by an equal key and not in every pair of a row
    spread = runs.select(frame, "lat_i", "a", "b", "node", F.explode(F.sequence(F.floor(F.col("a") / 32), F.floor(F.col("b") / 32))).alias("_at"))
    north = spread.select(frame, (F.col("lat_i") + 1).alias("lat_i"), "_at", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("other"))
    touch = spread.join(north, [frame, "lat_i", "_at"]).where("a <= b2 and a2 <= b").select(frame, F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    roots, _ = connected(runs.select(frame, "node"), touch, frame)
    first = Axis(("root",), (frame,), long_blocks("root"))
    labels = numbered(roots.select(frame, "root").distinct(), first, "label_id")
    placed = runs.select(frame, "lat_i", "_run", "node").join(roots, [frame, "node"]).join(labels, [frame, "root"])
    return cells.join(placed.select(frame, "lat_i", "_run", "label_id"), [frame, "lat_i", "_run"]).drop("_run")


def region_boxes(labelled: DataFrame, strength: Column | None = None, least: int = LEAST_CELLS) -> DataFrame:
    """Box, centre (mean of the cells), peak and size of regions of at least ``least`` cells."""
    return (
        labelled.groupBy("valid_time", "label_id")
        .agg(
            F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
            F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"),
            F.max(strength if strength is not None else F.col("z")).alias("peak_zscore"), F.count(F.lit(1)).alias("cell_count"),
        )
        .where(F.col("cell_count") >= least)
    )


def top_boxes(boxes: DataFrame) -> DataFrame:
    """The strongest region of every frame that has one."""
    w = Window.partitionBy("valid_time").orderBy(F.desc("peak_zscore"), "label_id")
    return boxes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def frame_series(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every frame, also those without a region: peak, flagged cells in regions, detected."""
    sums = boxes.groupBy("valid_time").agg(F.max("peak_zscore").alias("max_z"), F.sum("cell_count").alias("cells"), F.count(F.lit(1)).alias("regions"))
    return frames.join(sums, "valid_time", "left").select(
        "valid_time", "max_z", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("regions", F.lit(0)).alias("regions"), F.col("regions").isNotNull().alias("detected")
    )


def with_area(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("area_km2", box_area_km2(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max")))


