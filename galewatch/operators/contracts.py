"""Contracts of tables as counted violations, and a check that refuses."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_threat_id, ring_problem


class ContractError(ValueError):
    """Rows that a contract forbids; the text names each broken rule with its number of rows."""


@dataclass(frozen=True)
class Rule:
    """A name, and a condition that is true for rows that break it (NULL counts as kept)."""

    name: str
    broken: Column


def violations(rows: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(rule, violations) for every rule, also where nothing is broken; one pass over the rows."""
    rules = list(rules)
    counts = rows.agg(*[F.count(F.when(r.broken, 1)).alias(r.name) for r in rules])
    return counts.unpivot([], [r.name for r in rules], "rule", "violations")


def expect(rows: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The rows themselves, once no rule is broken; else ContractError."""
    broken = [(r["rule"], r["violations"]) for r in violations(rows, rules).where("violations > 0").collect()]  # a row a rule
    if broken:
        raise ContractError("; ".join(f"{name}: {n} rows" for name, n in sorted(broken)))
    return rows


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def history_rules(key: str = "threat_id", time: str = "timestamp") -> list[Rule]:
    """Of rows marked by ``with_previous``: a time for each row, none twice."""
    return [Rule("time_missing", F.col(time).isNull()), Rule("time_repeated", F.col(time) == F.col("previous_time")), Rule("key_missing", F.col(key).isNull())]


def with_previous(rows: DataFrame, key: str = "threat_id", time: str = "timestamp") -> DataFrame:
    """Add previous_time, the time of the row before in its history."""
    return rows.withColumn("previous_time", F.lag(time).over(Window.partitionBy(key).orderBy(time)))


def ordered_history(rows: DataFrame, key: str = "threat_id", time: str = "timestamp") -> DataFrame:
    """Rows of histories by key and time; ContractError where a key or a time is missing or a history has a time twice."""
    marked = with_previous(rows, key, time)
    return expect(marked, history_rules(key, time)).drop("previous_time").orderBy(key, time)


def concat_blocks(blocks: list[DataFrame], *key: str) -> DataFrame:
    """Blocks one after the other; ContractError if two of them have a key in common, or one has it twice."""
    joined = blocks[0]
    for b in blocks[1:]:
        joined = joined.unionByName(b)
    twice = repeated(joined, *key).limit(5).collect()
    if twice:
        raise ContractError("repeated: " + ", ".join(str(tuple(r[k] for k in key)) for r in twice))
    return joined


def threat_rules() -> list[Rule]:
    """Threat records: threat_id, severity, probability, model_id, earliest, likely, latest, ring."""
    p = F.col("probability")
    return [
        Rule("threat_id", ~is_threat_id(F.col("threat_id"))),
        Rule("severity", ~F.col("severity").isin("moderate", "severe", "extreme")),
        Rule("probability_range", ~p.between(0, 1)),
        Rule("probability_without_model", p.isNotNull() & F.col("model_id").isNull()),
        Rule("window_order", (F.col("earliest") > F.col("likely")) | (F.col("likely") > F.col("latest"))),
        Rule("ring", F.col("ring").isNotNull() & ring_problem(F.col("ring")).isNotNull()),
    ]


def score_rules(p: str = "p", y: str = "y") -> list[Rule]:
    """Probabilities between 0 and 1, outcomes 0 or 1, neither missing."""
    return [
        Rule("probability_missing", F.col(p).isNull()),
        Rule("probability_range", ~F.col(p).between(0, 1)),
        Rule("outcome", F.coalesce(~F.col(y).isin(0, 1), F.lit(True))),
    ]


def cube_rules(nodes: int, hours: float, low: float | None = None) -> list[Rule]:
    """Of frames from ``cube_frames``: every node once, frames ``hours`` apart, values finite (and not below ``low``)."""
    rules = [
        Rule("nodes", F.col("nodes") != nodes),
        Rule("node_repeated", F.col("rows") != F.col("nodes")),
        Rule("step", F.col("step_hours") != hours),
        Rule("missing", F.col("missing") > 0),
    ]
    return rules if low is None else [*rules, Rule("negative", F.col("lowest") < low)]


def cube_frames(cells: DataFrame, node: str = "node_id", time: str = "valid_time", value: str = "value") -> DataFrame:
    """A row for each frame of a cube: rows, nodes, missing values, lowest value, hours since the frame before."""
    frames = cells.groupBy(time).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(node).alias("nodes"), F.sum(F.col(value).isNull().cast("long")).alias("missing"), F.min(value).alias("lowest")
    )
    secs = F.unix_seconds(F.col(time).cast("timestamp"))
    month = F.date_trunc("month", time)
    # frames of a month in one window; the last frame of the month before comes from a table of a row a month
    last = frames.groupBy(month.alias("month")).agg(F.max(time).alias("last"))
    inside = F.lag(time).over(Window.partitionBy(month).orderBy(time))
    before = last.select(F.col("month").alias("m"), F.lag("last").over(Window.orderBy("month")).alias("before"))
    made = frames.withColumn("_month", month).withColumn("_inside", inside).join(F.broadcast(before), F.col("_month") == F.col("m"))
    gap = (secs - F.unix_seconds(F.coalesce("_inside", "before").cast("timestamp"))) / 3600.0
    return made.withColumn("step_hours", gap).drop("_month", "_inside", "m", "before")


def set_difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Keys that only one of two tables has: the keys and side (left or right)."""
    one, two = (df.select(*key).distinct() for df in (a, b))
    left = one.join(two, list(key), "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(two.join(one, list(key), "left_anti").withColumn("side", F.lit("right")))
