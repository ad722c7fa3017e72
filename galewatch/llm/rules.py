"""Quality rules: learned decision lists over text statistics, as DataFrame functions only.

Sequential covering: rules for the rejected class are grown condition by condition on one part of
the labelled rows, pruned on the other, and taken while they stay precise. The list becomes an
ordered Spark CASE expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, persist_table

WINDOW = 8
#: Labelled rows used for learning, at most; those with the smallest hashes of their ids.
FIT_ROWS = 40_000
#: Conditions a rule, rules a list, and quantile bins of a statistic.
MOST_CONDITIONS, MOST_RULES, BINS = 3, 6, 32
#: A rule must be right this often, on the part it was grown on and on the other.
PRECISION = 0.9
SYMBOLS = "#*$%&|<>"
STATISTICS = ("symbol_share", "word_length", "upper_share", "mark_share", "bar_share", "dup_line_share", "repeat_share", "log_words")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _count(text: Column, chars: str) -> Column:
    """How many characters of a set of ASCII characters a text has."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, all occurrences included.

    Windows are hashed; where some hash repeats, their places are sorted by hash, neighbours with
    equal hashes are kept, and the words that they cover are counted from the sorted places.
    """
    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return F.when(F.size(h) > window, F.transform(at, lambda i: F.xxhash64(F.slice(h, i, window)))).otherwise(F.array().cast("array<bigint>"))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _with(_with(hashes, windows), lambda grams: _covered(grams, window)).cast("long")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(grams: Column, window: int) -> Column:
    def again(s: Column) -> Column:
        following = F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))
        same = F.zip_with(s, following, lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))

    def cover(p: Column) -> Column:
        following = F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1)))
        gaps = F.zip_with(p, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda t, g: t + g)

    by_hash = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    return F.when(repeats, _with(_with(by_hash, again), cover)).otherwise(F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """Statistics of every text beside the other columns; null counts as an empty text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the shares named
    in STATISTICS (double, 0 for a text without words); columns of the caller with such a name are
    replaced.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_text", "_words", "_upper", "_marks", "_bars", *STATISTICS}
    rest = [F.col(f"`{c}`") for c in docs.columns if c != column and c.lower() not in made]
    text = F.coalesce(F.col(column), F.lit(""))
    base = docs.select(*rest, text.alias("_text"), _words(text).alias("_words"))
    n = F.size("_words")
    chars = F.char_length(F.translate(F.col("_text"), " \t\n\x0b\f\r", "")).cast("long")
    counted = base.select(
        *rest,
        n.cast("long").alias("n_words"),
        chars.alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        F.when(F.contains("_text", F.lit("\n")), duplicate_lines(F.col("_text"))).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        _count(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        _count(F.col("_text"), "!").alias("_marks"),
        _count(F.col("_text"), "|").alias("_bars"),
    )
    one, some = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / one).alias("symbol_share"),
        (F.col("word_chars") / one).alias("word_length"),
        (F.col("_upper") / some).alias("upper_share"),
        (F.col("_marks") / one).alias("mark_share"),
        (F.col("_bars") / one).alias("bar_share"),
        (F.col("n_dup_lines") / one).alias("dup_line_share"),
        (F.col("n_repeat_words") / one).alias("repeat_share"),
        F.ln(F.lit(1.0) + F.col("n_words")).alias("log_words"),
    )


#: A condition is (statistic, "<=" or ">", threshold); a rule is a tuple of conditions.
Rule = tuple[tuple[str, str, float], ...]


def condition(c: tuple[str, str, float]) -> Column:
    return F.col(c[0]) > c[2] if c[1] == ">" else F.col(c[0]) <= c[2]


def matches(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, map(condition, rule), F.lit(True))


def _above(stat: str):
    return lambda c: F.col(stat) > c


def _split_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, good) rows by statistic and bin: one pass, at most statistics * (bins + 1) rows back."""
    bins = F.array(*[
        F.struct(F.lit(s).alias("stat"), F.size(F.filter(F.array(*map(F.lit, cuts[s])), _above(s))).alias("bin")) for s in STATISTICS if cuts[s]
    ])
    got = rows.select("bad", F.explode(bins).alias("b")).groupBy("b.stat", "b.bin").agg(F.sum(F.col("bad")).alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    return {(r["stat"], r["bin"]): (r["bad"], r["good"]) for r in got}


def _best(counts: dict, cuts: dict, bad: int, good: int) -> tuple[float, tuple | None]:
    """The condition with the largest information gain for the bad rows that it covers."""
    base = math.log2((bad + 1) / (bad + good + 2))
    best: tuple[float, tuple | None] = (1e-9, None)
    for s in STATISTICS:
        low_bad = low_good = 0
        for i, c in enumerate(cuts[s]):
            b, g = counts.get((s, i), (0, 0))
            low_bad, low_good = low_bad + b, low_good + g
            for op, x, y in (("<=", low_bad, low_good), (">", bad - low_bad, good - low_good)):
                gain = x * (math.log2((x + 1) / (x + y + 2)) - base)
                if gain > best[0]:
                    best = gain, (s, op, float(c))
    return best


def _tally(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows for each of a few tests, in one pass."""
    made = rows.agg(*[F.sum(F.when(t, x)).alias(f"{n}{i}") for i, t in enumerate(tests) for n, x in (("b", F.col("bad")), ("g", 1 - F.col("bad")))]).first()
    return [(made[f"b{i}"] or 0, made[f"g{i}"] or 0) for i in range(len(tests))]


def learn_rules(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules for bad documents, in the order in which they were found; none without both classes.

    ``stats`` has doc_id and STATISTICS; labels have doc_id and quality (1 good, 0 bad; others are
    ignored). At most ``fit_rows`` labelled rows are used: a threshold on the hash of the id.
    Two thirds of them grow rules, one third prunes.
    """
    usable = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    n = usable.count()
    level = int(-(2**63) + min(1.0, 0.95 * fit_rows / max(1, n)) * (2**64 - 1))
    chosen = usable if n <= fit_rows else usable.where(F.xxhash64("doc_id") < F.lit(min(level, 2**63 - 1)).cast("long"))
    # at most fit_rows ids of 12 bytes
    rows = stats.join(F.broadcast(chosen.select("doc_id", (1 - F.col("quality")).cast("long").alias("bad"))), "doc_id")
    rows = persist_table(rows.select(*STATISTICS, "bad", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) > 0).alias("grows")))
    quantiles = rows.agg(*[F.percentile_approx(s, [i / BINS for i in range(1, BINS)], 2000).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted(set(quantiles[s] or [])) for s in STATISTICS}
    rules: list[Rule] = []
    left = rows
    while len(rules) < MOST_RULES:
        grown, here = (), left.where("grows")
        bad, good = _tally(here, [F.lit(True)])[0]
        if not bad or not (good or rules):
            break
        while len(grown) < MOST_CONDITIONS and good:
            _, c = _best(_split_counts(here, cuts), cuts, bad, good)
            if c is None:
                break
            grown, here = (*grown, c), here.where(condition(c))
            bad, good = _tally(here, [F.lit(True)])[0]
        if not grown:
            break
        # prune: the prefix of the conditions that is best on the other part
        tries = [grown[:k] for k in range(1, len(grown) + 1)]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in _tally(left.where("not grows"), [matches(t) for t in tries])]
        rule = tries[max(range(len(tries)), key=lambda k: (worth[k], -k))]
        (b1, g1), (b2, g2) = (_tally(part, [matches(rule)])[0] for part in (left.where("grows"), left.where("not grows")))
        if b1 < PRECISION * (b1 + g1) or b2 + g2 and b2 < PRECISION * (b2 + g2):
            break
        rules.append(rule)
        left = left.where(~matches(rule))
    return rules


def decision_list(rules: list[Rule]) -> Column:
    """True for a document that no rule rejects: an ordered CASE expression."""
    made = F.lit(True)
    for rule in reversed(rules):
        made = F.when(matches(rule), F.lit(False)).otherwise(made)
    return made


def apply_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rule (number of the rule that rejected it, from 1; else null).

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Null and empty
    texts have no words and fail. Repeated rows are each returned; without usable labels the list
    is empty and the base alone decides.
    """
    stats = persist_table(with_statistics(docs.select("doc_id", "text")))
    rules = learn_rules(stats, labels, fit_rows)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    hit = reduce(lambda made, i: F.when(matches(rules[i]), F.lit(i + 1)).otherwise(made), range(len(rules) - 1, -1, -1), F.lit(None).cast("int"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & decision_list(rules)).alias("kept"), hit.alias("rule"),
    )
