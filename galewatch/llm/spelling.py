"""Spelling variants: words one edit apart, each led to its most frequent form.

Of two words one edit apart the longer has m code points and the edit lies in one of PARTS parts of it;
before that part they agree from the left, behind it from the right. So both meet in a bucket of that part:
m, the part, and what they have around it. Inside a bucket words stand as rows of padded matrices of code
points, aligned left and right, and blocks of rows are compared column by column: two words are one edit
apart exactly when common prefix and common suffix together reach m - 1. Buckets beyond a block are spread
over tasks as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, persist_table

LETTERS = r"[A-Za-zÀ-ÿ]"
PARTS = 2
#: Words in a block, and code points in the rows of a block at most.
BLOCK, BLOCK_POINTS = 1024, 1 << 21
#: Rows of a tile side, and groups so small that they are compared together.
SIDE, SMALL, SHORT = 256, 32, 64
#: Rows that a task gathers before it compares small groups.
GATHER = 20_000


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): runs of letters, A to Z lower-cased, with at least ``least_length`` code points and ``least_count`` uses.

    In a document whose CRC-32 of "id:run" is divisible by ``every`` a run loses one code point, which
    plants misspellings. A null id is written as nothing, a null text has no words.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", low.alias("run"))
    h, size = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    word = F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _posts(words: DataFrame, parts: int) -> DataFrame:
    """(bucket, m, part, word, n): every word in the buckets of its own length and of the next."""
    spots = F.array(*[F.struct((F.col("size") + d).alias("m"), F.lit(q).alias("part")) for d in (0, 1) for q in range(parts)])
    rows = words.where("word <> ''").select("word", "n", F.char_length("word").alias("size")).select("word", "n", "size", F.inline(spots))
    start, end = (F.floor(F.col("m") * (F.col("part") + k) / parts).cast("int") for k in (0, 1))
    left, right = F.substr("word", F.lit(1), start), F.substr("word", F.col("size") - (F.col("m") - end) + 1)
    return rows.where(end > start).select(F.xxhash64("m", "part", left, right).alias("bucket"), "m", "part", "word", "n")


def _tiles(words: DataFrame, parts: int) -> DataFrame:
    """Posts with the block pair (low, high) that they are compared in; words of large buckets go to one pair for each block.

    Large buckets are found by a count and joined as Spark sees fit.
    """
    posts = _posts(words, parts)
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_POINTS) / F.col("m"))))
    sizes = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("m").alias("m"))
    large = persist_table(sizes.select("bucket", F.ceil(F.col("rows") / room).cast("int").alias("blocks")).where("blocks > 1"))
    split = posts.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.select("bucket", "m", "part", "word", "n", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points a column a row of two arrays: aligned left, aligned right."""
    size = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    width = int(size.max(initial=0))
    left = np.zeros((len(words), width), np.uint32)
    at = np.arange(width)
    left[at < size[:, None]] = points
    right = np.zeros_like(left)
    right[at >= width - size[:, None]] = points
    return size, np.ascontiguousarray(left.T), np.ascontiguousarray(right[:, ::-1].T)


def _common(a: np.ndarray, b: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Length of the common prefix of rows (columns first); padding is zero, so a shorter word ends it."""
    alive, total = np.ones(shape, bool), np.zeros(shape, np.int32)
    for x, y in zip(a, b, strict=True):
        alive &= (x == y) & (x > 0)
        if not alive.any():
            break
        total += alive
    return total


def _near(prefix: np.ndarray, suffix: np.ndarray, longer: np.ndarray, m: np.ndarray | int, part: np.ndarray | int, parts: int) -> np.ndarray:
    """One edit apart in a word of full length, this part being the first that can hold the edit: each pair comes once."""
    hit = (longer == m) & (prefix + suffix >= m - 1)
    for q in range(parts):
        start, end = m * q // parts, m * (q + 1) // parts
        holds = (end > start) & (prefix >= start) & (suffix >= m - end)
        hit &= np.where(q < part, ~holds, holds | (q > part))
    return hit


def _dense(words: list[str], block: np.ndarray, m: int, part: int, low: int, high: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of two blocks, tile by tile."""
    size, left, right = _matrices(words)
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    side = max(1, min(SIDE, BLOCK_POINTS // max(m, 1)))
    for i in range(0, len(a), side):
        for j in range(0 if low != high else i, len(b), side):
            x, y = a[i : i + side], b[j : j + side]
            shape = (len(x), len(y))
            p, s = (_common(t[:, x, None], t[:, None, y], shape) for t in (left, right))
            hit = _near(p, s, np.maximum(size[x][:, None], size[y][None, :]), m, part, parts)
            if low == high and i == j:
                hit = np.triu(hit, 1)
            r, c = np.nonzero(hit)
            yield x[r], y[c]


def _banded(words: list[str], group: np.ndarray, m: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of many small groups: every row with the one d rows on, while both are of one group."""
    size, left, right = _matrices(words)
    for d in range(1, SMALL):
        i = np.flatnonzero(group[:-d] == group[d:]) if d < len(group) else np.zeros(0, int)
        if not len(i):
            break
        j = i + d
        p, s = (_common(t[:, i], t[:, j], i.shape) for t in (left, right))
        near = _near(p, s, np.maximum(size[i], size[j]), m[i], part[i], parts)
        yield i[near], j[near]


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, near, near_n) for every two distinct words one edit apart, in both directions."""
    keys = ["bucket", "m", "part", "low", "high"]
    dealt = _tiles(words, parts).repartition(*keys).sortWithinPartitions(*keys)

    def found(words: list[str], n: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for i, j in pairs:
            if len(i):
                text = pa.array(words)
                yield pa.record_batch([text.take(pa.array(np.r_[i, j])), text.take(pa.array(np.r_[j, i])), pa.array(n[np.r_[j, i]])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # small groups: words, n, m, part
        count, held, name = 0, [], None

        def together() -> Iterator[pa.RecordBatch]:
            if waiting:
                words = [w for g in waiting for w in g[0]]
                sizes = [len(g[0]) for g in waiting]
                group, m, part = (np.repeat(x, sizes) for x in (np.arange(len(waiting)), [g[2] for g in waiting], [g[3] for g in waiting]))
                yield from found(words, np.concatenate([g[1] for g in waiting]), _banded(words, group, m, part, parts))

        def close(name: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal count, waiting
            words = [w for h in held for w in h[0]]
            n, block = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            _, m, part, low, high = name
            if low == high and len(words) <= SMALL and m <= SHORT:
                waiting.append((words, n, m, part))
                count += len(words)
                if count >= GATHER:
                    yield from together()
                    waiting, count = [], 0
            else:
                yield from found(words, n, _dense(words, block, m, part, low, high, parts))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            words, n, block = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            names = list(zip(*[c[np.r_[0, new]].tolist() for c in cols], strict=True))
            for here, a, b in zip(names, [0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if here != name:
                    if held and sum(len(h[0]) for h in held) > 1:
                        yield from close(name, held)
                    name, held = here, []
                held.append((words[a:b], n[a:b], block[a:b]))
        if held and sum(len(h[0]) for h in held) > 1:
            yield from close(name, held)
        yield from together()

    return map_arrow(dealt, run, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, parts: int = PARTS, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    A word's form is its most frequent near word (ties: the first in code-point order), if that one has
    ``times`` its n; the root is where forms lead. Rows that repeat a word are summed, a null n is 0, a
    null or empty word has no form. Forms grow by ``times`` at each step, so roots take few rounds.
    """
    words = persist_table(words.groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n")))
    near = near_pairs(words, parts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    rows = words.join(near, "word", "left")
    take = F.coalesce(-F.col("best.k") >= times * F.col("n"), F.lit(False)) & (-F.col("best.k") > F.col("n"))
    rows = persist_table(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(take, F.col("best.near")).alias("form"), F.when(take, -F.col("best.k")).alias("form_n")))
    roots = persist_table(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = persist_table(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        roots = step.select("word", "root")
        if not moved:
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

