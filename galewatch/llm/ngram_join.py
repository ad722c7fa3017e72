"""N-gram Jaccard self-join by rare-first prefix filtering, and the groups that its links form.

Documents with equal shingle sets form a class first; only one of each class is compared. A set's
shingles are ordered from rare to frequent (by how often their hash bucket occurs in the whole
corpus: any order that all sets share is right, a rarer prefix only means fewer candidates). Two
sets of sizes a and b that reach the threshold with an intersection of k share SHARED of their first
a - k + SHARED and b - k + SHARED shingles: the length and position filters. The difference of the sets
is bounded from below by that of their bitmaps, and then by the suffix filter, which cuts both sets
at common elements and compares the sizes of the parts. Every pair that is left is verified once on
the full sets; pairs that were verified before do not come again.

Links are wanted as groups, not as all pairs of a group. So two cheap rounds first compare every
set with representatives of its prefix shingles (first the sets that have most shingles in common
with others, which are likely in the middle of a group), and groups are merged; the last round
compares exactly those sets of a prefix shingle that are not yet in one group. No candidate is
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop_table, map_arrow, persist_table, shuffle_partitions

WORDS, PERCENT = 5, 75
#: Buckets of the corpus-wide shingle counts, 4 bytes each: what is broadcast is this size always.
#: They are summed in PARTS rows from each task.
BUCKETS, PARTS = 1 << 21, 512
#: Representatives that a set is compared with in each of the first rounds.
HUBS = 2
#: Shingles that two sets must share near the start of their order, if they are large enough.
SHARED = 3
#: Bits of a set's bitmap.
BITS = 1024
#: Ids in a broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Texts whose words are hashed together.
SLICE = 100
#: Rows that go to Python at once: a row with two full sets takes some 5 KB, and both sides hold a batch.
ROWS = 1000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = bytes([9, 10, 11, 12, 13])
_TO_SPACE = bytes.maketrans(bytes(range(65, 91)) + _BLANK, bytes(range(97, 123)) + b" " * 5)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_FACTORS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Bytes that are hashed together; words longer than LONG_WORD are hashed one by one.
CHUNK_BYTES, LONG_WORD = 1 << 20, 1 << 14
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_BYTES = _mix(np.arange(101, 357, dtype=np.uint64) * np.uint64(_BASE))


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, made once in each worker."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            made = np.full(CHUNK_BYTES, base, np.uint64)
            made[0] = 1
            _POWERS.append(np.cumprod(made))
    return _POWERS


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of at most CHUNK_BYTES bytes, words parted by spaces.

    A word's hash is a polynomial over its bytes: a difference of prefix sums, shifted back to the
    word's start, and mixed with its length.
    """
    b = np.frombuffer(data, np.uint8)
    space = np.r_[True, b == 32, True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, end = edge[::2], edge[1::2]
    up, down = _powers()
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[b] * up[: len(b)])]
    h = _mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * _M1)
    for k in np.flatnonzero(end - first > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[first[k] : end[k]])
    return h, first


class Shingler:
    """Hashes of the words and of the n-word shingles of texts."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts one after the other, and where each text's begin (and the end)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b" ".join(raw).translate(_TO_SPACE)
        starts = np.cumsum([0, *[len(r) + 1 for r in raw]])
        hashes, places, pos = [], [], 0
        while pos < len(data):
            end = pos + CHUNK_BYTES
            if end < len(data):
                end = data.rfind(b" ", pos, end)
                if end <= pos:  # one word fills the chunk
                    end = data.find(b" ", pos + CHUNK_BYTES)
                    end = len(data) if end < 0 else end
                    word = data[pos:end].lstrip(b" ")
                    hashes.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                    places.append(np.array([end - len(word)]))
                    pos = end
                    continue
            h, first = _hash_words(data[pos:end])
            hashes.append(h)
            places.append(first + pos)
            pos = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts)

    def ordered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of all texts in their order, and where each text's begin; a text with fewer
        than n words has none."""
        w, at = self.words(texts)
        size = np.diff(at)
        keep = np.maximum(size - self.n + 1, 0)
        h = np.zeros(max(len(w) - self.n + 1, 0), np.uint64)
        for k in range(self.n):
            h += w[k : len(h) + k] * _FACTORS[k]
        inside = np.arange(len(h)) - np.repeat(at[:-1], size)[: len(h)] < np.repeat(keep, size)[: len(h)]
        return _mix(h[inside]), np.r_[0, np.cumsum(keep)]

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Distinct shingle hashes of each text, sorted; a text with fewer than n words has its words as one."""
        w, at = self.words(texts)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = min(self.n, b - a)
            h = np.zeros(max(b - a - n + 1, 0) if n else 0, np.uint64)
            for k in range(n):
                h += w[a + k : a + k + len(h)] * _FACTORS[k]
            out.append(np.unique(_mix(h + np.uint64(n))))
        return out

    def shingles(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]


def needed(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Least intersection with which sets of sizes a and b reach percent / 100."""
    return F.ceil(((a + b) * percent).cast("double") / (100 + percent)).cast("long")


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - -(-percent * n // 100) + SHARED)


def shingle_counts(docs: DataFrame, column: str = "text", n: int = WORDS) -> np.ndarray:
    """How often each bucket of shingle hashes occurs in all documents: an array of BUCKETS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Shingler(n), np.zeros(BUCKETS, np.int64)
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for h in made.sets(batch.column(0)[at : at + SLICE].to_pylist()):
                    held.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
                    size += len(held[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield rows(total, range(PARTS))

    def rows(total: np.ndarray, parts) -> pa.RecordBatch:
        cut = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(PARTS, -1)
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([cut[p].tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((PARTS, BUCKETS // PARTS), np.int64), set()
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[p] += np.frombuffer(c, np.int32)
                seen.add(p)
        yield rows(total.ravel(), sorted(seen))

    schema = "part int, counts binary"
    spread = map_arrow(docs.select(column), count, schema).repartition(shuffle_partitions(docs.sparkSession), "part")
    total = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    for r in map_arrow(spread, add, schema).collect():  # BUCKETS numbers in all
        total[r["part"]] += np.frombuffer(r["counts"], np.int32)
    return total.ravel()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def signatures(docs: DataFrame, counts: np.ndarray, column: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, set_a, set_b (hashes of the set), prefix (array, rare first),
    bits (bitmap of the set)."""
    rank = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, often = Shingler(n), rank.value
        for batch in batches:
            sizes, a, b, prefixes, tails = [], [], [], [], []
            for h in (h for at in range(0, batch.num_rows, SLICE) for h in made.sets(batch.column(1)[at : at + SLICE].to_pylist())):
                sizes.append(len(h))
                a.append(xxhash.xxh3_64_intdigest(h.tobytes()) if len(h) else 0)
                b.append(xxhash.xxh64_intdigest(h.tobytes()) if len(h) else 0)
                order = np.lexsort((h, often[(h & np.uint64(BUCKETS - 1)).astype(np.int64)])) if len(h) else []
                p = prefix_length(len(h), percent) if len(h) else 0
                prefixes.append(h[order[:p]] if len(h) else h)
                bits = np.zeros(BITS, np.uint8)
                bits[((h >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)] = 1
                tails.append(np.packbits(bits).tobytes())
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])], pa.int32())
            flat = _signed(np.concatenate(prefixes)) if prefixes else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _signed(np.array(a, np.uint64)), _signed(np.array(b, np.uint64)), pa.ListArray.from_arrays(offsets, flat), pa.array(tails, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "prefix", "bits"],
            )

    return map_arrow(docs.select("doc_id", column), make, "doc_id long, n_shingles long, set_a long, set_b long, prefix array<long>, bits binary")


def connect(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node reachable.

    Every node repeatedly points at the smallest node that it or a neighbour points at; all stays
    in tables, and the pointers are also followed one step further each time, so long chains take
    logarithmically many rounds.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = persist_table(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    roots = persist_table(pairs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")))
    while True:
        near = pairs.join(roots.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        lower = roots.join(near, roots.node == near.x, "left").select("node", F.least("root", F.coalesce("r", "root")).alias("root"), F.col("root").alias("old"))
        # what the old root has learned, its followers take over: hook, then shortcut
        hook = lower.groupBy(F.col("old").alias("h")).agg(F.min("root").alias("hr"))
        step = lower.join(hook, lower.root == hook.h, "left").select("node", F.least("root", F.coalesce("hr", "root")).alias("root"), "old")
        step = persist_table(step)
        changed = not step.where("root <> old").isEmpty()
        roots = step.select("node", "root")
        if not changed:
            return roots


def few(ids: DataFrame) -> tuple[DataFrame, bool]:
    """Ids marked to be sent to all tasks if they are at most BROADCAST_IDS; and whether there are none."""
    n = ids.count()
    return (F.broadcast(ids) if n <= BROADCAST_IDS else ids), n == 0


def least_difference(u: np.ndarray, v: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the number of elements that only one of two sorted sets has.

    The suffix filter: both are cut at the middle element of one, and the sizes of what lies on either side
    must differ by so many at least; ``depth`` times over.
    """
    if not depth or not len(u) or not len(v):
        return abs(len(u) - len(v))
    mid = len(v) // 2
    k = int(u.searchsorted(v[mid]))
    hit = k < len(u) and u[k] == v[mid]
    return least_difference(u[:k], v[:mid], depth - 1) + least_difference(u[k + hit :], v[mid + 1 :], depth - 1) + (not hit)


def verify_pairs(pairs: DataFrame, docs: DataFrame, column: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the threshold: the suffix filter first, then
    the intersection."""
    pairs = persist_table(pairs.select("a", "b"))
    ids, none = few(persist_table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()))
    if none:
        return pairs

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(n)
        for batch in batches:
            sets = [h for at in range(0, batch.num_rows, SLICE) for h in made.sets(batch.column(1)[at : at + SLICE].to_pylist())]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
            flat = _signed(np.concatenate(sets)) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "set"])

    sets = map_arrow(docs.select("doc_id", column).join(ids, "doc_id", "left_semi"), make, "doc_id long, set array<long>")
    sets = persist_table(sets)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                if (100 + percent) * least_difference(u, v) > (100 - percent) * (len(u) + len(v)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("u")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("v")), "b").select("a", "b", "u", "v")
    found = persist_table(map_arrow(both, check, "a long, b long"))
    drop_table(sets)
    drop_table(pairs)
    return found


def _last(n: Column, need: Column) -> Column:
    """Last place in a set's order that counts for a pair that needs ``need`` shared shingles."""
    return F.least(n - need + (SHARED - 1), n - 1)


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (a, na, b, nb; one for each shared shingle up to the last places) to pairs that can still
    reach the threshold.

    Of the set whose last place comes first in the common order, every shared shingle up to there
    is also among the other's and so has a row; behind it no more than the rest of that set can be
    shared. Which set that is, is not known: the larger rest is allowed for.
    """
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    need = needed(F.col("na"), F.col("nb"), percent)
    rest = F.greatest(F.col("na") - _last(F.col("na"), need), F.col("nb") - _last(F.col("nb"), need)) - 1
    return counted.where(F.col("shared") + rest >= need).select("a", "b", "na", "nb")


def jaccard_links(docs: DataFrame, column: str = "text", n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, roots): members has doc_id, n_shingles and rep (the class representative: the smallest
    doc_id with the same set; itself for an empty set), roots has (node, root) of linked representatives."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias(column))
    counts = shingle_counts(docs, column, n)
    signed = persist_table(signatures(docs, counts, column, n, percent))
    key = ["n_shingles", "set_a", "set_b"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copied = persist_table(classes.where("copies > 1").select(*key, "rep"))
    members = signed.select("doc_id", *key).join(copied, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    members = persist_table(members)
    drop_table(copied)
    # one row of each class goes on: that of the smallest id; copies go before rows are moved
    first = Window.partitionBy(*key).orderBy("doc_id")
    reps = signed.where("n_shingles > 0 and doc_id is not null").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    reps = persist_table(reps)
    drop_table(signed)
    # of rows that share an id, each with a set that no smaller id has, the one with the smallest hashes stands for it
    again, none = few(persist_table(reps.groupBy("doc_id").count().where("count > 1").select("doc_id")))
    if not none:
        row = F.struct(*reps.columns)
        one = reps.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("set_a", "set_b")).alias("r")).select("r.*")
        reps = persist_table(reps.join(again, "doc_id", "left_anti").unionByName(one))
    posted = reps.select(F.col("doc_id").alias("d"), F.posexplode("prefix").alias("i", "gram"))
    # prefix shingles of one document only can link nothing; counted where they are dealt, so postings move once
    counted = posted.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    lists = persist_table(counted.where("c > 1").select("gram", "d", "i"))
    held = lists.groupBy("d").agg(F.count(F.lit(1)).alias("common"))
    size = persist_table(reps.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), F.size("prefix").alias("p")).join(held, "d"))
    # the share of a set's prefix that others have too: highest in the middle of a group
    central = F.struct(F.floor(F.col("common") * 64 / F.col("p")), F.xxhash64("d"))
    placed = lists.select("gram", "d").join(size.select("d", central.alias("rank")), "d")
    hubs = persist_table(placed.groupBy("gram").agg(F.max_by("d", "rank").alias("hub1"), F.min_by("d", F.xxhash64("d", F.lit(1))).alias("hub2")))
    near = size.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
    far = size.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    roots = None
    bitmaps = reps.select("doc_id", "bits")
    found: list[DataFrame] = []
    tried: DataFrame | None = None  # pairs that have been verified, whatever came of it
    for hub in ("hub1", "hub2"):
        # a set and the representative of each of its shingles: as many rows as postings at most
        star = lists.join(hubs.select("gram", F.col(hub).alias("b")), "gram").where("d <> b").groupBy(F.col("d").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))
        # those that share most come first; what they leave open is left to the exact round
        best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
        star = star.withColumn("k", F.row_number().over(best)).where(F.col("k") <= HUBS).drop("k")
        star = star.join(near, "a").join(far, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("shared") * 8 >= F.least("pa", "pb")))
        swap = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        star = star.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb")).distinct()
        if roots is not None:  # only what the first round left apart
            star = _apart(star, roots).join(tried, ["a", "b"], "left_anti")
        star = persist_table(star)
        tried = star.select("a", "b") if tried is None else tried.unionByName(star.select("a", "b"))
        # bitmaps first: what they rule out moves no sets
        found.append(verify_pairs(_bitmap_filter(star, bitmaps, percent), docs, column, n, percent))
        edges = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        roots = connect(edges)
    drop_table(hubs)
    # exact round: sets of one prefix shingle in different groups
    placed = lists.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    groups = placed.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
    open_grams = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("groups"), F.max_by("root", F.struct("c", "root")).alias("top")).where("groups > 1")
    left = persist_table(placed.join(open_grams.select("gram", "top"), "gram").join(size, "d"))
    a = left.where("root <> top").select("gram", *[F.col(c).alias(c + "a") for c in ("d", "n", "i", "root")], "top")
    b = left.select(F.col("gram").alias("gramb"), *[F.col(c).alias(c + "b") for c in ("d", "n", "i", "root")])
    # each pair once for a shingle: both outside its largest group, or the second inside
    once = (F.col("roota") != F.col("rootb")) & ((F.col("rootb") == F.col("top")) | (F.col("da") < F.col("db")))
    na, nb = F.col("na"), F.col("nb")
    close = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    need = needed(na, nb, percent)
    early = (F.col("ia") <= _last(na, need)) & (F.col("ib") <= _last(nb, need))
    met = a.join(b, (F.col("gram") == F.col("gramb")) & once & close & early)
    swap = F.col("da") > F.col("db")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = met.select(pick("da", "db").alias("a"), pick("db", "da").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"))
    pairs = persist_table(_shared(rows, percent).join(tried, ["a", "b"], "left_anti"))
    for done in (left, lists, size):
        drop_table(done)
    found.append(verify_pairs(_bitmap_filter(pairs, bitmaps, percent), docs, column, n, percent))
    drop_table(reps)
    edges = found[0].unionByName(found[1]).unionByName(found[2])
    return members, connect(edges)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends have different roots."""
    x = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    x = x.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return x.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _bitmap_filter(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose bitmaps differ in more bits than the sets may differ in shingles.

    Sets that reach the threshold have at most (100 - p) / (100 + p) * (a + b) shingles not in
    common, and each bit that differs stands for at least one of those.
    """
    ids, none = few(persist_table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()))
    if none:
        return pairs
    bitmaps = persist_table(bitmaps.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    rows = pairs.join(bitmaps.select(F.col("doc_id").alias("a"), F.col("bits").alias("ba")), "a").join(bitmaps.select(F.col("doc_id").alias("b"), F.col("bits").alias("bb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("ba", "bb")]
            differ = np.bitwise_count(both[0] ^ both[1]).sum(1).astype(np.int64)
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = differ * (100 + percent) <= sizes * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, check, "a long, b long")


def near_duplicate_groups(docs: DataFrame, column: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of n-word shingles
    (A-Z lower-cased). Null, empty and blank texts have an empty set and link with nothing; texts
    with fewer than n words have one shingle. Rows that share a doc_id are each returned; where
    their texts differ, the id links through that one of the sets without a smaller id that has the
    smallest hashes. Rows with a null doc_id come back with a null component.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        members, roots = jaccard_links(docs, column, n, percent)
    joined = members.join(roots, members.rep == roots.node, "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
