"""Tables that a job writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is made there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read again: later steps start from files that outlive any executor."""
    path = new_folder(rows.sparkSession, "kept")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
