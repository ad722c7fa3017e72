"""Running a stream to its end, for jobs that catch up with what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.scratch import new_folder


def caught_up(rows: DataFrame, build: Callable[[DataFrame], DataFrame], files: int | None = None) -> DataFrame:
    """What a streaming query makes of ``rows`` once it has read all of them.

    The rows are written to a folder that the stream reads (``files`` of them a batch; all at once without),
    its output goes to another, with checkpoints beside it. A second call on the same folders would go on
    where the first ended; here both are new.
    """
    spark = rows.sparkSession
    base = new_folder(spark, "stream")
    rows.write.parquet(f"{base}/in")
    reader = spark.readStream.schema(rows.schema)
    stream = build((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{base}/in"))
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
