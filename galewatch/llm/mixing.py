"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are token shares raised to an exponent between 0 (all alike) and 1 (as they are).
The exponent is bisected to meet a target entropy or a limit on repetition. Each source then gets
its weight's share of the token budget: whole passes over its documents and a last partial pass
that takes documents in a hashed order, block by block, until its tokens are spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table

#: Exponents tried in one pass over the sources, and passes: the error is below PROBES ** -PASSES.
PROBES, PASSES = 32, 5
#: Documents of a block in a source's permutation.
BLOCK_DOCS = 1000
SEED = 20_240_601


def token_count(text: Column) -> Column:
    """Estimated tokens of a text, at least 1: one for every eight characters, or fewer, of a run without
    white space. So a word counts one, and text without spaces, code and encoded data by their length.
    """
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S{1,8}+")), F.lit(1)).cast("long")


def source_sizes(docs: DataFrame) -> DataFrame:
    """source, docs, tokens; a null source is a source of its own, an empty text has one token."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


def find_exponent(sizes: DataFrame, target_entropy: float | None = None, repetition: float | None = None) -> float:
    """Largest exponent whose weights have ``target_entropy`` (a share of ln(number of sources)), or
    smallest whose most repeated source is passed over at most ``repetition`` times as often as the
    least repeated one. Every pass narrows the interval by PROBES over all sources in Spark.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        probes = [low + (high - low) * i / PROBES for i in range(PROBES + 1)]
        tried = sizes.select(F.ln(F.col("tokens").cast("double")).alias("size"), F.explode(F.array(*map(F.lit, probes))).alias("exponent"))
        weight = F.exp(F.col("exponent") * F.col("size"))
        rows = (
            tried.groupBy("exponent")
            .agg(
                F.sum(weight).alias("z"),
                F.sum(weight * F.col("exponent") * F.col("size")).alias("m"),
                F.count(F.lit(1)).alias("n"),
                (F.max("size") - F.min("size")).alias("ratio"),
            )
            .collect()
        )
        if not rows:
            return 1.0

        def meets(r) -> bool:
            if target_entropy is not None:
                entropy = math.log(r["z"]) - r["m"] / r["z"]
                return entropy >= target_entropy * math.log(r["n"]) - 1e-12 if r["n"] > 1 else True
            return (1 - r["exponent"]) * r["ratio"] <= math.log(repetition) + 1e-12

        good = sorted(r["exponent"] for r in rows if meets(r))
        if target_entropy is not None:  # entropy falls as the exponent grows: the last that meets it
            low = good[-1] if good else 0.0
            high = min([p for p in probes if p > low], default=low)
        else:  # repetition falls as the exponent grows: the first that meets it
            high = good[0] if good else 1.0
            low = max([p for p in probes if p < high], default=high)
        if high <= low:
            break
    return low if target_entropy is not None else high


def mix_sources(docs: DataFrame, budget_tokens: float | None = None, target_entropy: float | None = None, repetition: float | None = 2.0) -> DataFrame:
    """Repeat documents so that every source has its weight's share of the budget.

    Returns the columns of ``docs`` and pass (0, 1, ...), and place (long, the order to read in
    within a source and pass: blocks in hashed order, documents in hashed order inside, both another
    one in every pass; equal places, about one in 2 ** 32 pairs, are read by doc_id). Columns pass and
    place of the caller are replaced. Without a
    budget the least repeated source is passed over exactly once, so no document is dropped; with
    one, a source may get less than one pass. Equal rows are permuted by their text, and rows equal
    in all of doc_id, source and text in any order (they cannot be told apart). Empty input gives
    an empty result; null sources form one source; null and empty texts count one token.
    """
    own = [f"_row.`{c}`" for c in docs.columns if c.lower() not in ("pass", "place")]
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED)), F.lit(1 << 30))
    row = docs.select(  # the caller's columns in one, so that no name clashes
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", "doc_id", token_count(F.col("text")).alias("_tokens"),
        F.xxhash64("doc_id", F.xxhash64("text"), F.lit(SEED + 1)).alias("_order"), block.alias("_spread"),
    )
    sizes = persist_table(source_sizes(row.select("source", F.col("_tokens").alias("tokens"))))
    exponent = find_exponent(sizes, target_entropy, None if target_entropy is not None else repetition)
    raw = F.exp(exponent * F.ln(F.col("tokens").cast("double")))
    sums = sizes.agg(F.sum(raw).alias("z"), F.max(F.col("tokens") / raw).alias("need")).first()
    budget = budget_tokens if budget_tokens is not None else (sums["z"] or 0.0) * (sums["need"] or 0.0)
    # one row for each source
    plan = sizes.select(
        F.col("source").alias("_source"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).alias("_blocks"),
        (F.lit(budget) * raw / F.lit(sums["z"] or 1.0) / F.col("tokens")).alias("_passes"),
        (F.lit(budget) * raw / F.lit(sums["z"] or 1.0)).alias("_quota"),
        F.col("tokens").alias("_total"),
    )
    plan = plan.withColumn("_full", F.floor(F.col("_passes") + 1e-9).cast("int"))
    spare = F.col("_quota") - F.col("_full") * F.col("_total")
    plan = plan.withColumn("_rest", F.when(spare > 1e-6 * F.col("_total"), spare).otherwise(0.0))  # rounding is no pass
    placed = row.join(F.broadcast(plan) if sizes.count() <= 10_000 else plan, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_block", F.pmod(F.col("_spread"), F.col("_blocks")))
    # tokens before each block of a source: sums of sums, a row for each block
    blocks = placed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_in_block"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_before"), "_in_block")
    edge = placed.join(
        F.broadcast(blocks) if sizes.agg(F.sum(F.ceil(F.col("docs") / BLOCK_DOCS)).alias("b")).first()["b"] in range(100_001) else blocks,
        F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")),
    )
    inside = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_in_block") > F.col("_rest"))
    whole = edge.where(~inside).withColumn("_extra", (F.col("_before") + F.col("_in_block") <= F.col("_rest")).cast("int"))
    # only the block in which a source's tokens run out is summed document by document
    upto = Window.partitionBy("_source", "_block").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = edge.where(inside).withColumn("_done", F.coalesce(F.sum("_tokens").over(upto), F.lit(0)))
    part = part.withColumn("_extra", (F.col("_before") + F.col("_done") < F.col("_rest")).cast("int")).drop("_done")
    passes = F.col("_full") + F.col("_extra")
    return (
        whole.unionByName(part)
        .where(passes > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumn("place", F.xxhash64("_block", "pass").bitwiseAND(F.lit(-(1 << 32)).cast("long")) + F.pmod(F.xxhash64("_order", "pass"), F.lit(1 << 32)))
        .select(*own, "pass", "place")
    )
