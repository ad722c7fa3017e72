"""Session factory, and how the package reaches Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "galewatch", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds or overrides settings."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers where their path does not already hold it."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home in {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}:
        return
    sc = spark.sparkContext
    if not any(os.path.basename(f) == "galewatch.zip" for f in sc.listFiles):
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "galewatch"), "zip", home, "galewatch"))
