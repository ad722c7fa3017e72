"""Observations below a folder a region and a year: scans read the folders that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_regions(rows: DataFrame, path: str, region: str = "region", time: str = "valid_time") -> None:
    """Rows below region= and year= folders; those of a null region go to Hive's default folder.

    Rows are dealt by region, year and month, so that a region with most of the rows is written by many tasks.
    """
    y = F.year(time)
    made = rows.withColumn("year", y).repartition(region, "year", F.month(time))
    made.write.mode("overwrite").partitionBy(region, "year").parquet(path)


def read_regions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All regions; a condition on region or year, or a join on them, prunes folders before files are listed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def of_region(spark: SparkSession, path: str, region: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One region's rows, of the years ``first`` to ``last``."""
    rows = read_regions(spark, path).where(F.col("region") == region)
    rows = rows if first is None else rows.where(F.col("year") >= first)
    return rows if last is None else rows.where(F.col("year") <= last)


def of_regions(spark: SparkSession, path: str, wanted: DataFrame, region: str = "region") -> DataFrame:
    """Rows of the regions in a table: what it holds is known only when the job runs, and prunes then."""
    return read_regions(spark, path).join(wanted.select(region).where(F.col(region).isNotNull()).distinct(), region, "left_semi")
