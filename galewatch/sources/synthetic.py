"""Seeded fields that do not depend on partitions, and a data source that serves them.

Each number comes from a hash of the seed and its own place, never from a generator's state: a cell has the
same value whoever computes it, in whatever order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.alignment import bump
from ..session import ship_package

#: One degree of latitude.
KM = 111.32


def uniform(seed: int, *place: Column) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) for each place."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *place), 11) * F.lit(2.0**-53)


def normal(seed: int, *place: Column) -> Column:
    """A standard normal number for each place (Box and Muller)."""
    u, v = uniform(seed, F.lit("u"), *place), uniform(seed, F.lit("v"), *place)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def grid(spark: SparkSession, rows: int, cols: int, frames: int, start: str, hours: float = 1.0, south: float = 10.0, west: float = 76.0, step: float = 0.5) -> DataFrame:
    """valid_time, node_id, lat_i, lon_i, latitude, longitude of a regular grid at regular times."""
    k = F.col("id")
    lat_i, lon_i = F.floor(k / cols) % rows, k % cols
    at = F.timestamp_micros(F.unix_micros(F.expr(f"TIMESTAMP '{start}'")) + F.floor(k / (rows * cols)) * int(hours * 3_600_000_000)).cast("timestamp_ntz")
    return spark.range(rows * cols * frames).select(
        at.alias("valid_time"), F.floor(k / (rows * cols)).alias("frame"), (lat_i * cols + lon_i).cast("long").alias("node_id"), lat_i.cast("long").alias("lat_i"), lon_i.cast("long").alias("lon_i"),
        (south + step * lat_i).alias("latitude"), (west + step * lon_i).alias("longitude"),
    )


def seeded_field(cells: DataFrame, seed: int, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Add value: independent normal noise for each frame and node."""
    return cells.withColumn("value", mean + std * normal(seed, F.col("frame"), F.col("node_id")))


def smooth_field(cells: DataFrame, mean: float, amplitude: float, wave: float) -> DataFrame:
    """Add value: a plane wave of ``wave`` degrees, without sharp edges."""
    return cells.withColumn("value", mean + amplitude * F.sin(2 * math.pi / wave * (F.col("latitude") + F.col("longitude"))))


def sharp_field(cells: DataFrame, base: float, amplitude: float, at: tuple[float, float], km: float) -> DataFrame:
    """Add value: ``base`` and one peak at (latitude, longitude) that falls off within ``km``."""
    return cells.withColumn("value", base + bump(_away(F.lit(at[0]), F.lit(at[1])), F.lit(amplitude), F.lit(0.0), F.lit(km)))


def _away(lat: Column, lon: Column) -> Column:
    """Kilometres from a place, on a plane."""
    dy, dx = (F.col("latitude") - lat) * KM, (F.col("longitude") - lon) * KM * F.cos(F.radians(lat))
    return F.sqrt(dy * dy + dx * dx)


def moving_event(cells: DataFrame, start: tuple[float, float], per_frame: tuple[float, float], amplitude: float, km: float, seed: int = 0, noise: float = 0.0, base: float = 0.0) -> DataFrame:
    """Add value: a peak that moves by ``per_frame`` degrees (north, east) each frame, over seeded noise."""
    lat, lon = start[0] + per_frame[0] * F.col("frame"), start[1] + per_frame[1] * F.col("frame")
    peak = bump(_away(lat, lon), F.lit(amplitude), F.lit(0.0), F.lit(km))
    return cells.withColumn("value", base + peak + (noise * normal(seed, F.col("frame"), F.col("node_id")) if noise else F.lit(0.0)))


# --- the same noise as a source ---------------------------------------------------------------------

_MASK = (1 << 64) - 1


def mixed(seed: int, *place: int) -> int:
    """64 bits from a seed and whole numbers (the finaliser of SplitMix64, once a number)."""
    x = seed & _MASK
    for p in place:
        x = (x + 0x9E3779B97F4A7C15 + p) & _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        x ^= x >> 31
    return x


class Frames(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class FieldReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: type(d)(options.get(k, d))
        self.rows, self.cols, self.frames, self.seed = get("rows", 11), get("cols", 6), get("frames", 24), get("seed", 42)
        self.parts, self.mean, self.std = max(1, get("partitions", 4)), get("mean", 0.0), get("std", 1.0)
        if min(self.rows, self.cols) < 1 or self.frames < 0:
            raise ValueError("a field has rows and columns, and no negative number of frames")

    def partitions(self) -> list[Frames]:
        cuts = [self.frames * k // self.parts for k in range(self.parts + 1)]
        return [Frames(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [Frames(0, 0)]

    def read(self, partition: Frames) -> Iterator[tuple]:
        for f in range(partition.first, partition.last):
            for n in range(self.rows * self.cols):
                u, v = (mixed(self.seed, k, f, n) / 2**64 for k in (1, 2))
                yield f, n, n // self.cols, n % self.cols, self.mean + self.std * math.sqrt(-2 * math.log(1 - u * (1 - 2**-53))) * math.cos(2 * math.pi * v)


class FieldSource(DataSource):
    """``spark.read.format("seeded_field")`` with rows, cols, frames, seed, mean, std, partitions.

    The partitions decide who computes a frame, not what it holds.
    """

    @classmethod
    def name(cls) -> str:
        return "seeded_field"

    def schema(self) -> str:
        return "frame long, node_id long, lat_i long, lon_i long, value double"

    def reader(self, schema) -> FieldReader:
        return FieldReader(dict(self.options))


def register_sources(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FieldSource)
