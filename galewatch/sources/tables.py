"""Readers, keyed upserts, and the lift of the star-schema tables onto gridded observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.meteo import finite
from ..session import ship_package

MESH_ROWS, MESH_COLS = 11, 6
NODES = MESH_ROWS * MESH_COLS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; floating columns come without NaN and infinities."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wild = {f.name: finite(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(wild) if wild else df


def best_track(spark: SparkSession, path: str) -> DataFrame:
    """Best-track CSV: the units row goes (its time is no time, its season no number and its SID blank or
    text); of all other rows numbers and times that do not parse become NULL, the rows stay."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
    known = {"LAT": "lat", "LON": "lon", "USA_WIND": "usa_wind", "USA_PRES": "usa_pres", "WMO_WIND": "wmo_wind", "WMO_PRES": "wmo_pres", "DIST2LAND": "dist2land_km", "LANDFALL": "landfall_km"}
    text = {"SID": "sid", "NATURE": "nature", "USA_STATUS": "usa_status", "BASIN": "basin"}
    have = set(raw.columns)
    units = F.expr("try_cast(trim(SEASON) AS INT) IS NULL AND try_to_timestamp(ISO_TIME) IS NULL") & (F.coalesce(F.trim("SEASON"), F.lit("")) == "Year")
    return raw.where(~F.coalesce(units, F.lit(False))).select(
        *[F.trim(c).alias(n) for c, n in text.items() if c in have],
        F.expr("try_cast(trim(SEASON) AS INT)").alias("season"),
        F.upper(F.trim("NAME")).alias("name"),
        F.expr("CAST(try_to_timestamp(ISO_TIME) AS TIMESTAMP_NTZ)").alias("iso_time"),
        *[number(c).alias(n) for c, n in known.items() if c in have],
    )


def select_track(tracks: DataFrame, sid: str | None = None, name: str | None = None, season: int | None = None) -> DataFrame:
    """Rows that meet every given condition, by time."""
    for column, value in (("sid", sid), ("name", name.upper() if name else None), ("season", season)):
        if value is not None:
            tracks = tracks.where(F.col(column) == F.lit(value))
    return tracks.orderBy("iso_time")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` does not have."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti").select(*new.columns))


def read_threats(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Threat records from JSON, as a bare list or below ``threats``; bad records give NULL fields. With ``lines`` one
    record a line, as ``sinks.write_records`` writes them, so that large files are split over tasks."""
    wrapped = T.StructType([T.StructField("threats", T.ArrayType(schema)), *schema.fields])
    raw = spark.read.json(path, schema=wrapped, multiLine=not lines, mode="PERMISSIVE")
    inner = raw.where("threats is not null").select(F.inline("threats"))
    return inner.unionByName(raw.where("threats is null").select(*schema.fieldNames()))


def hour_or_day(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def observations(spark: SparkSession, sf_dir: str, unit: str = "day", by_type: bool = False) -> DataFrame:
    """Cell means of ``events`` on an 11 x 6 mesh: node_id, lat_i, lon_i, latitude, longitude, valid_time, value."""
    node = F.pmod("user_id", F.lit(NODES)).cast("long")
    lat_i, lon_i = (F.floor(node / MESH_COLS)).cast("long"), (node % MESH_COLS).cast("long")
    keys = [node.alias("node_id"), lat_i.alias("lat_i"), lon_i.alias("lon_i"), hour_or_day(F.col("ts"), unit).alias("valid_time")]
    keys += [F.col("event_type")] if by_type else []
    cells = table(spark, sf_dir, "events").groupBy(*keys).agg(F.avg("value").alias("value"))
    return cells.withColumn("latitude", 10 + 0.5 * F.col("lat_i")).withColumn("longitude", 76.0 + F.col("lon_i"))


def fine_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 x 20 field of mean prices: i, j, value."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") % 20).cast("long").alias("i"), (F.col("l_orderkey") % 20).cast("long").alias("j"))
        .agg(F.avg("l_extendedprice").alias("value"))
    )


def coarse_field(fine: DataFrame) -> DataFrame:
    """Every second row and column of a field, at its own indices."""
    return fine.where("i % 2 = 0 and j % 2 = 0")


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value of every priority: threat_id, timestamp, severity, radius."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("threat_id"), hour_or_day(F.col("o_orderdate"), "month").alias("timestamp"))
        .agg(F.sum("o_totalprice").alias("severity"), F.count(F.lit(1)).cast("double").alias("radius"))
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and outcome pairs: doc_id, p, y."""
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p"), F.col("toxic").cast("int").alias("y"))
