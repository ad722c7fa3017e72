"""Mean and deviation as a table of parts that are merged, not computed anew, when data is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_table, upsert_table
from .contracts import ContractError


def parts(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, n, mean, m2) of the known values: count, mean and sum of squared deviations."""
    known = F.count(value)
    return rows.groupBy(*key).agg(known.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * known).alias("m2"))


def merged(made: DataFrame, *key: str) -> DataFrame:
    """Parts with equal ``key`` as one part.

    Deviations from the parts' means add up, and each mean's deviation from the common mean counts for all
    its rows. The parts' common mean is taken first and everything is measured from there, so large
    means cancel nothing.
    """
    some = made.where("n > 0")
    whole = some.groupBy(*key).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    off = (some.join(whole, list(key)) if key else some.join(F.broadcast(whole))).withColumn("_d", F.col("mean") - F.col("_mean"))  # one row without a key
    n, d = F.sum("n"), F.sum(F.col("n") * F.col("_d"))
    m2 = F.sum("m2") + F.sum(F.col("n") * F.col("_d") * F.col("_d")) - d * d / n
    return off.groupBy(*key).agg(n.alias("n"), (F.first("_mean") + d / n).alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def deviation() -> Column:
    """Population standard deviation of a part; NULL without rows."""
    return F.when(F.col("n") > 0, F.sqrt(F.col("m2") / F.col("n")))


def add_months(rows: DataFrame, path: str, value: str, time: str, *key: str) -> DataFrame:
    """Write the parts of the months in ``rows`` to the table at ``path`` and return all of its parts.

    Only these months are read; a month that the table has already is replaced, so the same data may come
    twice.
    """
    dated = rows.withColumn("month", F.date_trunc("month", time).cast("timestamp_ntz"))
    return upsert_table(parts(dated, value, *key, "month"), path, *key, "month")


def statistics(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """(key, n, mean, std) of everything in the table; ContractError where a deviation is zero or nothing is known."""
    made = read_table(spark, path)
    if made is None:
        raise ContractError(f"no moments at {path}")
    got = merged(made, *key).select(*key, "n", "mean", deviation().alias("std"))
    flat = got.where("std <= 1e-12 * greatest(abs(mean), 1)").limit(5).collect()  # what rounding leaves of nothing
    if flat:
        raise ContractError("no deviation: " + ", ".join(str(tuple(r[k] for k in key)) for r in flat))
    return got


def standardised(rows: DataFrame, stats: DataFrame, value: str, *key: str) -> DataFrame:
    """``value`` less the mean, over the deviation, of its key; NULL where the key is not in ``stats``."""
    both = rows.join(stats.select(*key, "mean", "std"), list(key), "left")
    return both.withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")
