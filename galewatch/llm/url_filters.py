"""URL filters: explicit host and path rules, then link-graph propagation for the rest.

Trust starts at hosts that an allow rule fits and follows links by personalised PageRank; distrust
starts at hosts that a block rule fits and follows links backwards, to those who link to them. A
host whose distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

#: (host, path, verdict): a rule fits the host and all its subdomains where the path starts so.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING, SAVE_EVERY = 0.85, 6
#: Ranks are final when no round adds more than this share of a host's own rank.
TOLERANCE = 1e-9
#: A host is blocked when distrust > trust * OUTWEIGH * (1 + MARGIN): a rounding error decides nothing,
#: whatever the size of the ranks.
OUTWEIGH, MARGIN = 1.0, 1e-7
#: Rounds and absolute margin of the SQL oracle only, which can not iterate until nothing changes.
ROUNDS, FLOOR = 12, 1e-12


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(after, r"(?s)^([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    empty = F.lit("")
    return F.coalesce(ascii_lower, empty), F.coalesce(path, empty)


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def judge_by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    made = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        made = F.when(_fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(made)
    return made


def host_edges(pages: DataFrame, host: Column) -> DataFrame:
    """Links between different hosts with their numbers: src, dst, n. Summed before the shuffle."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href\s*=\s*[\"']?[a-z][a-z0-9+.-]*:(//[^\s\"'<>]+)"), F.lit(1))
    linked = pages.where(F.col("html").contains("://")).select(host.alias("src"), F.explode(found).alias("link"))
    dst, _ = url_parts(F.concat(F.lit("x:"), F.col("link")))
    return (
        linked.select("src", dst.alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, total: float, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank over (src, dst, n) from (host, weight), weights divided by ``total``;
    returns (host, rank).

    Every round passes on what the last one added, until that is at most ``tolerance`` of the rank of
    every host: so also all hosts that links lead to are reached. What a host without links would
    pass on is given up, not spread, so ranks only decay there.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    links = persist_table(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    base = seeds.groupBy("host").agg((F.sum("weight") / total).alias("seed"))
    rank = base.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    if links.isEmpty():
        return rank
    state = persist_table(rank.withColumn("added", F.col("rank")))
    while True:
        for _ in range(SAVE_EVERY):
            moved = links.join(state, links.src == state.host).select(F.col("dst").alias("host"), F.lit(0.0).alias("rank"), (F.col("added") * F.col("share") * damping).alias("added"))
            sums = moved.unionByName(state.select("host", "rank", F.lit(0.0).alias("added"))).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("added").alias("added"))
            state = sums.select("host", (F.col("rank") + F.col("added")).alias("rank"), "added")
        state = persist_table(state)
        if state.where(F.col("added") > F.col("rank") * tolerance).isEmpty():
            return state.select("host", "rank")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, trust, distrust.

    A rule that fits decides; of several, the longest. Other pages follow their host: block where
    distrust outweighs trust, allow elsewhere (so also hosts that no trust or distrust reaches, and
    pages with a null or unparsable url, whose host and path are empty). Repeated rows are all
    judged. Seeds are weighted by how many pages of the host a rule decides.
    """
    host, path = url_parts(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path")).drop("url")
    judged = named.withColumn("hit", judge_by_rules(F.col("host"), F.col("path"), rules))
    seeds = judged.where("hit is not null").groupBy("host", F.col("hit.verdict").alias("verdict")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    seeds = persist_table(seeds)
    edges = persist_table(host_edges(pages.select("url", "html"), host))
    total = seeds.agg(F.sum("weight").alias("t")).first()["t"] or 1.0  # one scale for trust and distrust
    trust = propagate(edges, seeds.where("verdict = 'allow'"), total)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds.where("verdict = 'block'"), total)
    known = (
        trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    # one row a host meets many pages of it: Spark splits hot hosts as skewed join partitions
    scored = judged.join(known, "host", "left").select(
        "page_id", "host", "path", "hit", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    by_host = F.when(F.col("distrust") > F.col("trust") * (OUTWEIGH * (1 + MARGIN)), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), by_host).alias("verdict"), "trust", "distrust")
