"""Scans along an ordered axis without one window over all of it.

The axis is cut into blocks by a rule that keeps its order (months, for times). A window never spans more
than a block; what has to cross a border comes from a table with a row for each block: the edge row that a
neighbour needs, or the sum of all that lies before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """Columns that order the rows (no two rows of a group alike in all of them), columns that part them into
    groups, and the block of a row: a column that never falls along the order."""

    order: tuple[str, ...]
    group: tuple[str, ...] = ()
    block: Column | None = None

    def blocks(self) -> Column:
        return self.block if self.block is not None else F.date_trunc("month", self.order[0])

    def inside(self):
        return Window.partitionBy(*self.group, "_block").orderBy(*self.order)

    def across(self):
        """Over a row a block."""
        return (Window.partitionBy(*self.group) if self.group else Window).orderBy("_block")

    def joined(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """Rows with the columns of their block's edge row."""
        keys = [*self.group, "_block"]
        other = edges.select(*[F.col(k).alias(f"_e{n}") for n, k in enumerate(keys)], *[c for c in edges.columns if c not in keys])
        same = None
        for n, k in enumerate(keys):
            one = rows[k].eqNullSafe(other[f"_e{n}"])
            same = one if same is None else same & one
        return rows.join(other, same, "left").drop(*[f"_e{n}" for n in range(len(keys))])


def with_neighbour(rows: DataFrame, axis: Axis, name: str, *columns: str, ahead: bool = True) -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the next row of the group (of the one before, unless ``ahead``), NULL
    where there is none."""
    rows = rows.withColumn("_block", axis.blocks())
    whole = F.struct(*columns)
    pick = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*axis.group, "_block").agg(pick(whole, F.struct(*axis.order)).alias("_edge"))
    shift = F.lead if ahead else F.lag
    edges = edges.select(*axis.group, "_block", shift("_edge").over(axis.across()).alias("_carried"))
    near = rows.withColumn("_near", shift(whole).over(axis.inside()))
    return axis.joined(near, edges).withColumn(name, F.coalesce("_near", "_carried")).drop("_near", "_carried", "_block")


def running_sum(rows: DataFrame, axis: Axis, value: Column, name: str, before: bool = False) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to this one (this one left out, if
    ``before``); NULL values add nothing."""
    rows = rows.withColumn("_block", axis.blocks()).withColumn("_value", value)
    totals = rows.groupBy(*axis.group, "_block").agg(F.sum("_value").alias("_total"))
    past = axis.across().rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*axis.group, "_block", F.sum("_total").over(past).alias("_ahead"))
    here = F.sum("_value").over(axis.inside().rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    zero = F.lit(0)
    summed = axis.joined(rows.withColumn("_here", here), totals).withColumn(name, F.coalesce("_here", zero) + F.coalesce("_ahead", zero))
    return summed.drop("_here", "_ahead", "_value", "_block")


def numbered(rows: DataFrame, axis: Axis, name: str) -> DataFrame:
    """Add ``name``: the place of each row in its group, from 1."""
    return running_sum(rows, axis, F.lit(1).cast("long"), name)


def long_blocks(column: str, size: int = 4096) -> Column:
    """Blocks of ``size`` whole numbers."""
    return F.floor(F.col(column) / size)
