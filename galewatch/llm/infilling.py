"""Fill-in-middle: documents cut at token borders into prefix, middle and suffix, and put in another order.

Tokens are words with the blanks before them (and blanks at the end). Texts are cut into chunks where a
rolling hash of the last 32 code points says so, so copies of a passage give the same chunks wherever they
stand. What a chunk adds to a count of tokens is kept in a cache by its content; the counts of a document's
chunks, joined at their borders, give its tokens, and only the chunks that hold a cut are looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import free_name

MARKS = ("<P>", "<S>", "<M>")
#: Chunks of some 2^BITS code points, never shorter than LEAST (but at the end) nor longer than MOST.
BITS, LEAST, MOST = 9, 64, 8192
#: Code points that each of the two generations of a task's cache holds.
CACHE = 8_000_000
BLOCK = 1 << 20


def _blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def _borders(points: np.ndarray) -> np.ndarray:
    """Places behind which the hash of the last 32 code points starts with BITS zeros."""
    v = points * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x85EBCA77)
    for width in (1, 2, 4, 8, 16):  # sum of 2^k times the k-th last, in five doublings
        v[width:] += v[:-width] << np.uint32(width)
    return np.flatnonzero(v >> np.uint32(32 - BITS) == 0) + 1


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of a text. The hash is taken in blocks of a million code points that overlap by 32."""
    found = []
    for at in range(0, len(text), BLOCK):
        from_ = max(0, at - 32)
        points = np.frombuffer(text[from_ : at + BLOCK].encode("utf-32-le"), np.uint32).copy()
        spots = _borders(points) + from_
        found.append(spots[spots > at])
    spots = np.concatenate(found) if found else np.zeros(0, int)
    ends, last, n = [], 0, len(text)
    while last < n:
        k = np.searchsorted(spots, last + LEAST)
        last = min(n, last + MOST, int(spots[k]) if k < len(spots) else n)
        ends.append(last)
    return ends


def _inner_ends(chunk: str) -> np.ndarray:
    """Places in a chunk where a word is followed by a blank."""
    blank = _blank(np.frombuffer(chunk.encode("utf-32-le"), np.uint32))
    return np.flatnonzero(~blank[:-1] & blank[1:]) + 1


class ChunkCache:
    """Summaries of chunks by content: words that end inside, blank first, blank last.

    The content itself is the key, so a summary is used only for an equal chunk. Two generations of
    bounded size: what is used moves to the young one, and a full young one replaces the old.
    """

    def __init__(self, room: int = CACHE):
        self.young, self.old, self.room, self.held, self.hits = {}, {}, room, 0, 0

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            self.hits += got is not None
            if got is None:
                ends = _blank(np.array([ord(chunk[0]), ord(chunk[-1])]))
                got = (len(_inner_ends(chunk)), bool(ends[0]), bool(ends[1]))
            self.young[chunk] = got
            self.held += len(chunk)
            if self.held > self.room:
                self.young, self.old, self.held = {}, self.young, 0
        else:
            self.hits += 1
        return got


class Counted:
    """A text's chunks, how many words end up to each chunk's end, and its number of tokens."""

    def __init__(self, text: str, cache: ChunkCache):
        self.text, self.ends = text, chunk_ends(text)
        known = [cache.summary(text[a:b]) for a, b in zip([0, *self.ends], self.ends, strict=False)]
        words = []
        for k, (inside, _, blank_last) in enumerate(known):
            # a word ends at the border where the next chunk starts with a blank, and at the end of the text
            words.append(inside + (not blank_last and (k + 1 == len(known) or known[k + 1][1])))
        self.words = np.cumsum(words) if words else np.zeros(1, int)
        self.tokens = int(self.words[-1]) + bool(known and known[-1][2])

    def place(self, k: int) -> int:
        """Code points in the first ``k`` tokens."""
        if k <= 0:
            return 0
        if k > self.words[-1]:
            return len(self.text)
        c = int(np.searchsorted(self.words, k))
        start, end = (self.ends[c - 1] if c else 0), self.ends[c]
        inner = _inner_ends(self.text[start:end])
        nth = k - (int(self.words[c - 1]) if c else 0) - 1
        return start + int(inner[nth]) if nth < len(inner) else end


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    cache = ChunkCache()
    for texts, a, b in batches:
        rows = []
        for text, x, y in zip(texts, a, b, strict=True):
            counted = Counted(text, cache)
            x, y = sorted((x % (counted.tokens + 1), y % (counted.tokens + 1)))
            rows.append((counted.tokens, counted.place(x), counted.place(y)))
        yield pd.DataFrame(rows, columns=["n", "low", "high"])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Add n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output to the rows.

    ``rate`` percent of the documents are cut, ``spm`` percent of those start with the suffix; the choice
    and both cuts come from the SHA-256 of the seed and the key (null: empty) alone, so equal keys are cut
    alike. A null text is empty; empty texts and texts that hold a mark stay plain, with null lengths.
    Columns of these names are replaced.
    """
    ship_package(docs.sparkSession)
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    whole = F.coalesce(F.col(text), F.lit(""))
    cuts = F.pandas_udf(_cuts, "n long, low long, high long")
    made = free_name("_cut", docs)
    rows = docs.drop("n", "form", "prefix_chars", "middle_chars", "output").withColumn(made, cuts(whole, h[0], h[1]))
    low, high = (F.col(made)[c].cast("int") for c in ("low", "high"))
    marked = whole.contains(MARKS[0]) | whole.contains(MARKS[1]) | whole.contains(MARKS[2])
    form = F.when((whole == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(whole, F.lit(1), low), F.substr(whole, low + 1, high - low), F.substr(whole, high + 1)
    p, s, m = (F.lit(x) for x in MARKS)
    is_ = F.col("form")
    output = F.when(is_ == "plain", whole).when(is_ == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    rows = rows.withColumn("form", form).withColumn("output", output)
    cut = is_ != "plain"
    return rows.withColumns({"n": F.col(made)["n"], "prefix_chars": F.when(cut, low.cast("long")), "middle_chars": F.when(cut, (high - low).cast("long"))}).drop(made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>")  # psm: nothing, prefix, suffix, middle; spm: nothing, suffix, prefix, middle
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
