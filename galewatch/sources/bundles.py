"""Writes that check what they write in the same job, and bundles whose parts must agree with each other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError, Rule


def observed(rows: DataFrame, rules: Iterable[Rule], **metrics: Column) -> tuple[DataFrame, Observation]:
    """Rows that count, while they pass, how many break each rule, and what else is asked for."""
    watch = Observation()
    counts = [F.count(F.when(r.broken, 1)).alias(f"rule:{r.name}") for r in rules]
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), *counts, *[m.alias(k) for k, m in metrics.items()]), watch


def _refuse(problems: dict[str, str]) -> None:
    if problems:
        raise ContractError("; ".join(f"{k}: {v}" for k, v in sorted(problems.items())))


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if fs.exists(path(target)):
        raise ContractError(f"{target} is there already")
    if not fs.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def write_checked(rows: DataFrame, path: str, rules: Iterable[Rule], **metrics: Column) -> dict:
    """Write ``rows`` to ``path`` if none of them breaks a rule; ContractError otherwise, and nothing is there.

    The rows are read once: they are counted while they are written to a folder beside the target, which is
    then moved. Returns the counted rows and metrics.
    """
    spark = rows.sparkSession
    made, watch = observed(rows, rules, **metrics)
    staged = f"{path.rstrip('/')}.staged"
    made.write.mode("overwrite").parquet(staged)
    got = watch.get
    _refuse({k.split(":", 1)[1]: f"{n} rows" for k, n in got.items() if k.startswith("rule:") and n})
    _move(spark, staged, path)
    return {k: v for k, v in got.items() if not k.startswith("rule:")}


#: What a bundle's record says about its tensor.
RECORD = ("frames", "nodes", "features", "first", "last")


def check_bundle(tensor: DataFrame, record: dict, times: DataFrame, nodes: DataFrame, features: tuple[str, ...], path: str, hours: float = 1.0) -> dict:
    """Write a bundle's tensor (valid_time, node_id and a column a feature) to ``path`` if all parts agree.

    The record has frames, nodes, features, first and last; ``times`` lists the frames (valid_time) and ``nodes``
    the nodes (node_id, latitude, longitude). Refused, each by its name: a cell without a frame or node in the
    lists, frames, nodes, names or ends that differ from the record, frames not ``hours`` apart, node ids
    that are not 0 to n - 1, missing cells, missing values, repeated cells. The tensor is scanned once,
    by the job that writes it: the lists are joined to it and its metrics observed on the way.
    """
    spark = tensor.sparkSession
    t = times.select("valid_time").distinct()
    secs = F.unix_seconds(F.col("valid_time").cast("timestamp"))
    axis = t.agg(F.count(F.lit(1)).alias("n"), F.min("valid_time").alias("first"), F.max("valid_time").alias("last"), F.min(secs).alias("a"), F.max(secs).alias("b"), F.count(F.when(F.pmod(secs, F.lit(int(hours * 3600))) != 0, 1)).alias("off"))
    a = axis.first()
    mesh = nodes.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("ids"), F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.countDistinct("latitude", "longitude").alias("places")).first()
    problems: dict[str, str] = {}
    if times.count() != a["n"]:
        problems["times_repeated"] = "a frame is listed twice"
    if a["n"] and (a["b"] - a["a"]) != (a["n"] - 1) * hours * 3600:
        problems["times_spacing"] = f"{a['n']} frames from {a['first']} to {a['last']} are not {hours:g} hours apart"
    if not (mesh["n"] == mesh["ids"] == mesh["places"]) or mesh["n"] and (mesh["low"], mesh["high"]) != (0, mesh["n"] - 1):
        problems["node_table"] = f"{mesh['n']} rows, {mesh['ids']} ids from {mesh['low']} to {mesh['high']}, {mesh['places']} places"
    said = {"frames": a["n"], "nodes": mesh["n"], "features": list(features), "first": str(a["first"]), "last": str(a["last"])}
    for k in RECORD:
        have = list(record.get(k) or []) if k == "features" else str(record.get(k)) if k in ("first", "last") else record.get(k)
        if have != said[k]:
            problems[f"record_{k}"] = f"{have} in the record, {said[k]} in the bundle"
    absent = [f for f in features if f not in tensor.columns]
    if absent:
        problems["tensor_features"] = "no column " + ", ".join(absent)
    _refuse(problems)
    known = tensor.join(t.withColumn("_frame", F.lit(True)), "valid_time", "left").join(nodes.select("node_id", F.lit(True).alias("_node")), "node_id", "left")
    lacking = F.lit(False)
    for f in features:
        lacking = lacking | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    rules = [Rule("cell_without_frame", F.col("_frame").isNull()), Rule("cell_without_node", F.col("_node").isNull()), Rule("value_missing", lacking)]
    # equal counts and equal sums of two independent hashes: every cell of the full product once, but for a chance of 2^-60
    cell = lambda seed: F.xxhash64(F.lit(seed), F.col("valid_time"), F.col("node_id").cast("long"))
    sums = {f"h{k}": F.sum(F.shiftrightunsigned(cell(k), 24).cast("decimal(38,0)")) for k in (1, 2)}
    made, watch = observed(known, rules, **sums)
    staged = f"{path.rstrip('/')}.staged"
    made.drop("_frame", "_node").write.mode("overwrite").parquet(staged)
    got = watch.get
    problems = {k.split(":", 1)[1]: f"{n} rows" for k, n in got.items() if k.startswith("rule:") and n}
    if got["rows"] != a["n"] * mesh["n"]:
        problems["tensor_cells"] = f"{got['rows']} cells for {a['n']} frames and {mesh['n']} nodes"
    elif not problems:
        # the product of the two lists, which are small beside the tensor's values
        want = t.join(nodes.select("node_id")).agg(*[s.alias(k) for k, s in sums.items()]).first()
        if any(want[k] != got[k] for k in sums):
            problems["tensor_repeated"] = "some cells twice, others not at all"
    _refuse(problems)
    _move(spark, staged, path)
    return {"rows": got["rows"], "frames": a["n"], "nodes": mesh["n"]}
