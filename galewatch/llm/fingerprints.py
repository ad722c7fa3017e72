"""Document fingerprints by consistent weighted sampling, as DataFrame functions only.

For every weighted term and every sample number k, three hash-derived variables
r ~ Gamma(2,1), c ~ Gamma(2,1) and b ~ Uniform(0,1) give

    t = floor(ln(weight) / r + b),    ln a = ln(c) - r * (t - b + 1)

and sample k of a document is its smallest ln a. ``ln a`` depends on (term, t, k) alone, so two
documents agree on a sample with a probability equal to their generalised Jaccard similarity
(sum of the minima of the weights over the sum of the maxima).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, sha256_hex, shuffle_partitions

#: Samples in a fingerprint: the standard error of a likeness is at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 40
#: Documents in one id range; ranges are the unit in which "the next document" is looked up.
RANGE_DOCS = 200
#: Most quantile cuts and most ranges: what is broadcast never exceeds MAX_RANGES rows of 40 bytes.
MAX_CUTS, MAX_RANGES = 64, 65_536


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of sample ``k`` for a 64-bit term and the logarithm of its weight."""
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda h, shift, bits: (
        F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 0.5
    ) * (2.0**-bits)
    r = -F.ln(unit(h1, 0, 32) * unit(h1, 32, 32))
    log_c = F.ln(-F.ln(unit(h2, 0, 24) * unit(h2, 24, 24)))
    b = unit(h2, 48, 16)
    return log_c - r * (F.floor(log_weight / r + b) - b + 1.0)


def sketch(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Samples of every bag: ``terms`` has ``keys``, term (long) and weight (positive number).

    A term that appears in several rows of a bag must come with the same weight. Bags without a
    row do not appear in the result. Returns the keys and ``samples`` (array of double).
    """
    logged = terms.select(*keys, "term", F.ln(F.col("weight").cast("double")).alias("log_weight"))
    made = logged.groupBy(*keys).agg(
        *[F.min(sample_value(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)]
    )
    return made.select(*keys, F.array(*[F.col(f"s{k}") for k in range(samples)]).alias("samples"))


def fingerprint(samples: Column) -> Column:
    """Printable form: eight hexadecimal digits for each sample; an empty bag has an empty one."""
    return F.array_join(
        F.transform(samples, lambda s: F.right(F.lpad(F.hex(F.xxhash64(s)), 16, "0"), F.lit(8))), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty bags are alike, an empty and another bag are not."""
    both = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, hit: n + F.coalesce(hit, F.lit(0))
    )
    return (
        F.when(a.isNull() & b.isNull(), 1.0)
        .when(a.isNull() | b.isNull(), 0.0)
        .otherwise(both / F.greatest(F.size(a), F.lit(1)))
        .cast("double")
    )


def _cuts(docs: DataFrame) -> tuple[list[int], int]:
    """Ids in order, from the least to the largest, that cut the table, and the ranges between two of them."""
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("doc_id", [i / MAX_CUTS for i in range(MAX_CUTS + 1)], 10_000).alias("cuts"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
    ).first()
    cuts = sorted({*(stats["cuts"] or []), stats["low"] or 0, stats["high"] or 0})
    return cuts, max(1, min(MAX_RANGES, stats["n"] // RANGE_DOCS) // max(1, len(cuts) - 1))


def _ranges(docs: DataFrame, cuts: list[int], inner: int) -> DataFrame:
    """Add ``range``: documents with larger ids are in ranges with smaller numbers. Ids may lie anywhere in
    64 bits; a step between two cuts need not fit into them."""
    bounds = F.array(*[F.lit(c).cast("long") for c in [*cuts, cuts[-1]]])
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts[1:]]), lambda c: c <= F.col("doc_id"))) if len(cuts) > 1 else F.lit(0)
    placed = docs.withColumn("at", at)
    wide = lambda c: c.cast("decimal(20,0)")
    low, high = F.element_at(bounds, F.col("at") + 1), F.element_at(bounds, F.col("at") + 2)
    share = (wide(F.col("doc_id")) - wide(low)).cast("double") / F.greatest((wide(high) - wide(low)).cast("double"), F.lit(1.0))
    up = F.col("at") * inner + F.least(F.floor(share * inner), F.lit(inner - 1))
    return placed.withColumn("range", F.coalesce(-up, F.lit(1)).cast("long")).drop("at")


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Give every document the text of the next one by descending doc_id (the first, for the last).

    Only ranges of ids are shuffled, once; the first document of a range also travels to the range
    before it as a *guest*, so no window spans more than a range. Rows with one doc_id follow each
    other by text; a null doc_id comes last. Returns doc_id, text, range, guest, place, next_text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # approximate quantiles may differ from one run to the next: both sides of the join take the same cuts
    cuts = _cuts(docs.select("doc_id"))
    ranged = _ranges(rows, *cuts)
    firsts = _ranges(docs.select("doc_id"), *cuts).groupBy("range").agg(F.max("doc_id").alias("first"))
    ahead = Window.orderBy("range")  # at most MAX_RANGES rows, one for each range
    firsts = firsts.select(
        "range", "first", F.coalesce(F.lag("range").over(ahead), F.max("range").over(Window.partitionBy())).alias("host")
    )
    hosted = ranged.join(F.broadcast(firsts), "range", "left")
    guest = hosted.select(
        F.explode(
            F.when(
                F.col("doc_id").eqNullSafe(F.col("first")),
                F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))),
            ).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))
        ).alias("to"),
        "doc_id",
        "text",
    ).select("to.range", "to.guest", "doc_id", "text").where(F.col("range").isNotNull())  # never null; said here, both readers of the shuffle share one plan
    # three times the usual number: both texts of a document and their word counts share a task's memory
    partitions = partitions or 3 * shuffle_partitions(spark)
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return guest.repartition(partitions, "range").select(
        "range",
        "guest",
        "doc_id",
        "text",
        F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next_text"),
    )


def edited(text: Column, following: Column) -> Column:
    """The last third of ``text`` (rounded down) replaced by as many first characters of ``following``."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, with two likenesses.

    Terms are the words of the text, weighted by how often they occur. Null text counts as empty;
    an empty text has the fingerprint "" and is like other empty texts only. Repeated rows are kept
    and each gets its own result; a single document is its own next. Other columns are ignored.
    """
    laid = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    meta = laid.select("range", "place", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), sha256_hex(F.col("edited_text")).alias("edited_sha256"))
    terms = (
        laid.select("range", "place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited_text").alias("text")))).alias("v"))
        .select("range", "place", "v.kind", F.explode(F.split("v.text", BLANK)).alias("word"))
        .where("word <> ''")
        .groupBy("range", "place", "kind", F.xxhash64("word").alias("term"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    made = (
        sketch(terms, ["range", "place", "kind"], samples)
        .groupBy("range", "place")
        .agg(
            F.max(F.when(F.col("kind") == 0, F.col("samples"))).alias("own"),
            F.max(F.when(F.col("kind") == 1, F.col("samples"))).alias("other"),
        )
    )
    order = Window.partitionBy("range").orderBy("place")
    return (
        meta.join(made, ["range", "place"], "left")
        .withColumn("following", F.lead("own").over(order))
        .where("guest = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.coalesce(fingerprint(F.col("own")), F.lit("")).alias("fingerprint"),
            F.coalesce(fingerprint(F.col("other")), F.lit("")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("other")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )
