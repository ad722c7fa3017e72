"""Connected components of large graphs: hooks onto smaller roots, and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: More rounds than this would take more nodes than numbers can name.
MOST_ROUNDS = 200


def connected(nodes: DataFrame, edges: DataFrame, *group: str) -> tuple[DataFrame, int]:
    """(group, node, root), root the smallest node that edges (group, a, b) lead to, and the rounds it took.

    In a round every root takes over the smallest root that any of its members touches, and every node then
    points at its root's root. Roots of a chain halve, so rounds are logarithmic in the longest way, not
    as many as its steps. Each round is a table.
    """
    both = edges.select(*group, F.col("a").alias("x"), F.col("b").alias("y"))
    pairs = kept(both.unionByName(both.select(*group, F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    roots = kept(nodes.select(*group, "node", F.col("node").alias("root")).distinct())
    for done in range(MOST_ROUNDS):
        x = roots.select(*group, F.col("node").alias("x"), F.col("root").alias("rx"))
        y = roots.select(*group, F.col("node").alias("y"), F.col("root").alias("ry"))
        touch = pairs.join(x, [*group, "x"]).join(y, [*group, "y"]).where("rx > ry")
        hook = kept(touch.groupBy(*group, F.col("rx").alias("root")).agg(F.min("ry").alias("up")))
        if hook.isEmpty():
            return roots, done
        # a hook's target may itself be hooked: follow the hooks by doubling until they end
        while True:
            further = hook.select(*group, F.col("root").alias("up"), F.col("up").alias("next"))
            step = kept(hook.join(further, [*group, "up"], "left").select(*group, "root", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
            hook = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        roots = kept(roots.join(hook, [*group, "root"], "left").select(*group, "node", F.coalesce("up", "root").alias("root")))
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
