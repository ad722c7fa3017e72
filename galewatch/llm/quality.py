"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair says that one document is better than another. Scores are linear in statistics of the
text; the weights minimise the logistic loss of the feature differences of the pairs. A quantile of
the scores of the labelled documents then separates kept from rejected ones, and a logistic curve
through that point turns scores into numbers between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents used for fitting, at most; those with the smallest hashes of their ids.
FIT_ROWS = 24_000
#: Preference pairs for each document of the rarer class.
PAIRS_EACH = 8
#: Score at which a document counts as good.
KEEP_AT = 0.3
RIDGE = 1e-3
FEATURES = [
    "log_chars", "upper", "digits", "punctuation", "symbols", "bars", "marks", "braces", "lines", "word_length",
    "long_words", "short_words", "distinct", "top_word", "repeated_lines", "line_length", "shouting", "ended", "non_ascii",
]

_UPPER = list(range(65, 91))
_DIGIT = list(range(48, 58))
_STOPS = [ord(c) for c in ".,;:?'\""]
_SIGNS = [ord(c) for c in "#*$%&<>@^~=+"]


def text_features(text: str) -> list[float]:
    """Statistics of one text, each bounded; an empty text has zeros."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[192:].sum()))
    n = len(data)
    words = text.split()
    n_words = len(words)
    sizes = np.fromiter(map(len, words), np.int32, n_words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    upper = int(count[_UPPER].sum())
    return [
        min(np.log1p(n), 14.0) / 14.0,
        upper / letters,
        int(count[_DIGIT].sum()) / n,
        min(1.0, int(count[_STOPS].sum()) / n_words),
        min(1.0, int(count[_SIGNS].sum()) / n_words),
        min(1.0, int(count[124]) / n_words),
        min(1.0, int(count[33]) / n_words),
        min(1.0, int(count[[40, 41, 91, 93, 123, 125, 95, 92, 47]].sum()) / n_words),
        min(1.0, len(lines) / n_words),
        min(float(sizes.mean()), 20.0) / 20.0,
        float((sizes > 12).mean()),
        float((sizes < 4).mean()),
        len(seen) / n_words,
        max(seen.values()) / n_words,
        1.0 - len(set(lines)) / len(lines),
        min(n / len(lines), 2000.0) / 2000.0,
        float(upper > 0.5 * letters),
        float(text.rstrip()[-1] in ".!?"),
        int(count[128:].sum()) / n,
    ]


def with_features(rows: DataFrame, column: str = "text") -> DataFrame:
    """Add ``features`` (array of double) for every text, whole."""
    made = F.pandas_udf(lambda s: pd.Series([text_features(t) for t in s]), "array<double>")
    return rows.withColumn("features", made(F.col(column)))


def in_fit_folds(doc_id: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


class Ranker:
    """Weights of the scores, and the curve from a score to a number between 0 and 1."""

    def __init__(self, weights: np.ndarray, centre: np.ndarray, spread: np.ndarray, cut: float, slope: float):
        self.weights, self.centre, self.spread, self.cut, self.slope = weights, centre, spread, cut, slope

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """KEEP_AT exactly at the cut, rising with the utility."""
        z = self.slope * (self.utility(x) - self.cut) + np.log(KEEP_AT / (1 - KEEP_AT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_ranker(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Fit from features and 0/1 labels. With one class only, every document scores alike (kept).

    Every document of the rarer class is paired with PAIRS_EACH of the other, dealt round-robin.
    The cut is the score quantile at which the share of documents below it equals the share of
    label 0 among the labelled ones, or the midpoint of the gap there.
    """
    width = x.shape[1] if x.ndim == 2 and x.shape[0] else len(FEATURES)
    good, bad = (np.flatnonzero(y == v) for v in (1, 0)) if len(y) else (np.array([]), np.array([]))
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), -5.0, 1.0)
    centre, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = (x - centre) / spread
    m = PAIRS_EACH * min(len(good), len(bad))
    step = np.arange(m)
    better, worse = good[(step * 7919) % len(good) if len(good) > len(bad) else step % len(good)], bad[(step * 7919) % len(bad) if len(bad) > len(good) else step % len(bad)]
    d = z[better] - z[worse]
    w = np.zeros(width)
    for _ in range(30):  # Newton steps on the mean logistic loss of the differences
        p = 1.0 / (1.0 + np.exp(-np.clip(d @ w, -35, 35)))
        grad = d.T @ (p - 1) / m + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + RIDGE * np.eye(width)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    u = z @ w
    cut = float(np.quantile(u, len(bad) / len(y)))
    slope = 4.0 / max(1e-9, float(u[good].mean() - u[bad].mean()))
    return Ranker(w, centre, spread, cut, slope)


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranker:
    """Learn from at most ``fit_rows`` labelled documents outside the held-out fold.

    Labels that are null, and ids with contradicting labels, are left out. The bound is kept by a
    threshold on the hash of the id, so no sort is needed and the same documents come each time.
    """
    usable = (
        labels.where(in_fit_folds(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
    )
    n = usable.count()
    share = min(1.0, 0.95 * fit_rows / max(1, n))
    level = int(-(2**63) + share * (2**64 - 1))
    chosen = usable if n <= fit_rows else usable.where(F.xxhash64("doc_id") < F.lit(min(level, 2**63 - 1)).cast("long"))
    # at most fit_rows ids of 12 bytes
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(joined).groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("features").alias("features")).limit(fit_rows + 1).collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit_ranker(x, np.array([r["quality"] for r in got], int))


def score_texts(docs: DataFrame, ranker: Ranker, column: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) for every row by the fitted ranker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(ranker.score(x), dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(column)))


def classify_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted (1 from KEEP_AT on).

    Null and empty texts get the score of a text whose statistics are all zero. Repeated rows get
    equal scores. A null doc_id is never learned from and is not held out.
    """
    ranker = learn(docs, labels, fit_rows)
    scored = score_texts(docs.select("doc_id", "text"), ranker)
    held = F.coalesce(~in_fit_folds(F.col("doc_id")) & F.col("doc_id").isNotNull(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
