"""Small helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where the session names none and runs on one machine (as in tests) a temporary folder is
    made and set; on a cluster, whose executors could not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def persist_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    It cuts the lineage at a file that outlives any executor, so a lost executor costs only the
    tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``persist_table`` wrote and that no later step reads."""
    spark = df.sparkSession
    home = scratch_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder and home.split(":")[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever the session was started.

    Workers outlive their tasks, so what Arrow has kept for later goes back when a task ends.
    """
    ship_package(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs run inside see ``value``; the session's own setting comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, most: int):
    """Jobs run inside send at most ``most`` rows at once to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(key, "0"))
    return setting(spark, key, str(min(most, own) if own > 0 else most))


def shuffles_go(spark: SparkSession):
    """What jobs run inside have shuffled is deleted when each ends, not when the driver next collects garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, made longer until no column of ``df`` has it (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text, without empty strings; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
