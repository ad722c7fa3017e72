"""Sinks: records with a header, keyed tables that are replaced as a whole, reports, split data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError
from .tables import upsert


def write_records(rows: DataFrame, path: str, **meta: str) -> None:
    """Records as JSON lines below ``path``/records, and one line of what is known about them beside."""
    rows.write.mode("overwrite").json(f"{path}/records")
    spark = rows.sparkSession
    n = spark.read.schema(rows.schema).json(f"{path}/records").count()
    header = spark.range(1).select(F.lit(n).alias("records"), *[F.lit(v).alias(k) for k, v in sorted(meta.items())])
    header.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """Names of the versions of a table, the newest first; None where there is no table."""
    try:
        return spark.read.text(f"{path}/versions").orderBy(F.desc("value"))
    except Exception as e:  # noqa: BLE001  Spark names a missing path in its own class only
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a keyed table; None before the first write."""
    names = _versions(spark, path)
    newest = names.first() if names is not None else None
    return spark.read.parquet(f"{path}/{newest['value'].split(' ')[1]}") if newest else None


def _name_version(spark: SparkSession, path: str, number: int, name: str) -> None:
    """Name a version under its number, unless somebody else has taken the number: the file is made only if it is new."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:010d}.txt")
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(file.getParent())
    try:
        out = fs.create(file, False)
    except Exception as e:  # noqa: BLE001  the bridge wraps what the file system throws
        if "AlreadyExists" in str(e):
            raise ContractError(f"another writer has made version {number} of {path}; read it and try again") from None
        raise
    out.writeBytes(f"{number:010d} {name}\n")
    out.close()


def upsert_table(new: DataFrame, path: str, *key: str) -> DataFrame:
    """Replace the rows of a table whose keys ``new`` has and keep the others.

    The whole result is written as a new version first and then named in one small file, so that readers see
    either the old table or the new one, also if the write fails on the way. Of two writers that started from
    one version the second is refused (ContractError), where the file system can make a file only if it is new.
    """
    spark = new.sparkSession
    known = _versions(spark, path)
    newest = known.first() if known is not None else None
    number, old = (int(newest["value"].split(" ")[0]) + 1, spark.read.parquet(f"{path}/{newest['value'].split(' ')[1]}")) if newest else (0, None)
    made = new if old is None else upsert(old, new, *key)
    name = f"v-{uuid.uuid4().hex}"
    made.write.parquet(f"{path}/{name}")
    _name_version(spark, path, number, name)
    return spark.read.parquet(f"{path}/{name}")


def write_frames(frames: DataFrame, trajectory: DataFrame, path: str) -> None:
    """What a detector run gives: its frames and the trajectory through them."""
    frames.write.mode("overwrite").json(f"{path}/frames")
    trajectory.write.mode("overwrite").json(f"{path}/trajectory")


def write_splits(rows: DataFrame, path: str, time: str = "valid_time", last_train: int = 2019, last_validate: int = 2021) -> None:
    """Rows below split, year and month, every row in exactly one split."""
    y = F.year(time)
    split = F.when(y <= last_train, "train").when(y <= last_validate, "validate").otherwise("test")
    made = rows.withColumn("split", split).withColumn("year", y).withColumn("month", F.month(time))
    made.repartition("split", "year", "month").write.mode("overwrite").partitionBy("split", "year", "month").parquet(path)


def markdown(metrics: DataFrame) -> str:
    """A table of metrics (a row each) as Markdown; NULL is shown as n/a."""
    rows = metrics.collect()  # a row a metric
    show = lambda v: "n/a" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + " --- |" * len(metrics.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def geojson(boxes: DataFrame) -> DataFrame:
    """One GeoJSON feature a row: the box as a closed ring, the other columns as properties."""
    w, e, s, n = (F.col(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max"))
    ring = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    rest = [c for c in boxes.columns if c not in ("lon_min", "lon_max", "lat_min", "lat_max")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(*rest).alias("properties"),
    )
    return boxes.select(F.to_json(feature).alias("value"))
