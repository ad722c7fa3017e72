"""Reply trees, fill-in-middle and spelling variants: registered queries and odd inputs against plain recomputations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from galewatch.llm import infilling, queries, reply_trees, spelling

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SAID = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()


# --- reply trees -----------------------------------------------------------------------------------


def test_op11(spark):
    turns = duckdb.sql(f"SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM '{DATA}/conversations.parquet' ORDER BY ALL").fetchall()
    turns += [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]
    want = defaultdict(list)
    for c, _, role, text in turns:
        want[c].append((role, text))
    got = {r.conv_id: r for r in queries.queries()["op11_chat_formatting"](spark, DATA).collect()}
    assert set(got) == set(want)
    for c, said in want.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), sha(loss))
        assert r.formatted_chars > sum(len(t) for _, t in said)


MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def plain_paths(rows, best):
    """All root-to-leaf paths of each tree by plain walking, ranked."""
    nodes = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in rows}
    inner = {(t, p) for (t, n), (p, _) in nodes.items() if p is not None}
    out = defaultdict(list)
    for t, n in nodes:
        if (t, n) not in inner:
            walk, at = [], n
            while at is not None and (t, at) in nodes and at not in walk:
                walk.append(at)
                at = nodes[t, at][0]
            if at is None or (t, at) not in nodes:
                out[t].append((-sum(nodes[t, m][1] for m in walk), -len(walk), n, walk[::-1]))
    return {(t, p[2]): (k + 1, p[3]) for t, ps in out.items() for k, p in enumerate(sorted(ps)[:best])}


@pytest.mark.parametrize("best", [1, 3, None])
def test_branches_against_plain_walks(spark, best):
    rng = random.Random(3)
    rows = []
    for t in (None, 1, 2):
        for n in range(60):
            parent = rng.choice([None, *range(n)]) if n else None
            rows.append((t, n, n - 1 if t == 2 and n else parent, rng.choice(["user", "assistant"]), f"text {n}", rng.choice([None, 0.0, 1.0, 2.5])))
    rows += [(1, 100, 999, "user", "orphan", 9.0), (1, 200, 201, "user", "a", 1.0), (1, 201, 200, "user", "cycle", 1.0), (1, 202, 201, "user", "below a cycle", 1.0), (1, 300, 300, "user", "itself", 1.0), (1, None, 3, "user", "no id", 1.0)]
    table = spark.createDataFrame([*rows, rows[5]], MESSAGES)  # one row repeated
    got = defaultdict(list)
    ranks = {}
    for r in reply_trees.paths(reply_trees._single(table), best).collect():
        got[r.tree, r.leaf].append((r.place, r.node))
        ranks[r.tree, r.leaf] = r["rank"]
    want = plain_paths([r for r in rows if r[1] is not None], best)
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {k: w for k, (_, w) in want.items()}
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    assert best is None or ranks == {k: r for k, (r, _) in want.items()}


def test_texts_come_back_from_the_template(spark):
    parts = ["\\", "#", "##", "###", "#####", "</turn>", "<", "/turn>", ": ", ":", "\n", "é😀", "", "$1", "### assistant: x</turn>\n"]
    texts = ["".join(p) for p in itertools.product(parts, repeat=2)]
    rows = [(7, k, k - 1 if k else None, ["user", "assistant", "a: \\b", None][k % 4], t if k % 11 else None, None) for k, t in enumerate(texts)]
    out = reply_trees.format_paths(spark.createDataFrame(rows, MESSAGES))
    assert out.count() == 1
    made = out.withColumn("turns", reply_trees.read_turns(F.col("formatted"))).withColumn("said", reply_trees.read_loss(F.col("formatted"), F.col("loss"))).first()
    assert [(t.role, t.text) for t in made.turns] == [(r[3] or "", r[4] or "") for r in rows]
    assert made.said == [r[4] or "" for r in rows if r[3] == "assistant"]
    for r, escaped in zip(rows, re.split("</turn>\n", made.formatted)[:-1], strict=True):
        assert "</turn>" not in escaped and "###" not in escaped[4:], r


def test_conversations_with_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, "assistant", "first", "x"), (None, 5, None, None, "x"), (2, 3, "assistant", "y" * 300_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.tree: [(t.role, t.text) for t in r.turns] for r in reply_trees.format_paths(reply_trees.as_chains(turns, "conv_id", "turn")).select("tree", reply_trees.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert out == {1: [("assistant", "first"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")], 2: [("assistant", "y" * 300_000)]}
    assert reply_trees.format_paths(reply_trees.as_chains(turns.limit(0), "conv_id", "turn")).count() == 0


# --- fill-in-middle --------------------------------------------------------------------------------


def plain_cut(key, text):
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in infilling.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_op12(spark, rows):
    got = {r.doc_id: r for r in queries.queries()["op12_fill_in_middle"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, form, p, m, out = plain_cut(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(t))


def test_odd_texts_are_cut_alike(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", "<P>x", "x <M> y", "z" * 200_000, " " * 50_000, "w " * 40_000, "é😀  x " * 500, "\x1fa\x0bb\x0cc"]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(3000))) for _ in range(60)]
    rows = [(k, t, "own") for k, t in enumerate(texts)] + [(None, "no id at all", "own"), (4, "a", "own"), (4, "another text under one id", "own")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _cut string").withColumn("form", F.lit("replaced"))
    out = infilling.fill_in_middle(table).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.back, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r._cut) for r in out.collect()), key=str)
    want = sorted(((i, t or "", plain_cut("" if i is None else i, t or ""), "own") for i, t, _ in rows), key=str)
    assert got == want and {g[2][1] for g in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(table.limit(0)).count() == 0


def test_chunks_follow_the_content():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    cache = infilling.ChunkCache()
    infilling.Counted("x" * 1000 + passage, cache)
    before = cache.hits
    counted = infilling.Counted("other words " * 50 + passage, cache)
    assert cache.hits - before > 0.9 * len(counted.ends) - 5  # the shared passage is not looked at again
    assert counted.tokens == len(TOKEN.findall(counted.text))
    ends = infilling.chunk_ends(passage)
    assert ends[-1] == len(passage) and all(infilling.LEAST <= b - a <= infilling.MOST for a, b in itertools.pairwise(ends[:-1]))
    long = passage * 60  # longer than a block of the hash
    whole = np.frombuffer(long.encode("utf-32-le"), np.uint32).copy()
    spots = infilling._borders(whole)
    kept, last = [], 0
    while last < len(long):
        k = np.searchsorted(spots, last + infilling.LEAST)
        last = min(len(long), last + infilling.MOST, int(spots[k]) if k < len(spots) else len(long))
        kept.append(last)
    assert infilling.chunk_ends(long) == kept


def test_a_full_cache_stays_bounded():
    cache = infilling.ChunkCache(room=5_000)
    for k in range(300):
        assert cache.summary(f"{k} " * 20)[0] == 20
    assert sum(map(len, cache.young)) <= 5_100 and sum(map(len, cache.old)) <= 5_100


# --- spelling variants -----------------------------------------------------------------------------


def plain_counts(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def edits(word, letters):
    for k in range(len(word) + 1):
        for c in letters:
            yield word[:k] + c + word[k:]
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            for c in letters:
                yield word[:k] + c + word[k + 1 :]


def plain_variants(n):
    letters = sorted({c for w in n for c in w})
    out = {}
    for w, k in n.items():
        near = {e for e in edits(w, letters) if e in n and e != w}
        best = min(((-n[e], e) for e in near), default=None)
        out[w] = [best[1] if best and -best[0] >= 10 * k else None, None, k, len(near), -best[0] if best and -best[0] >= 10 * k else None]
    for w, v in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        v[1] = root
    return {w: tuple(v) for w, v in out.items()}


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op13(spark, rows):
    got = queries.queries()["op13_spelling_variants"](spark, DATA)
    want = plain_variants(plain_counts(rows))
    assert collected(got) == want and got.count() == len(want) and any(v[0] for v in want.values())


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_all_ways_to_tile_agree(spark, parts, monkeypatch):
    """Few letters, so that words are close to many others; blocks and tiles so small that buckets are split."""
    for name, value in (("BLOCK", 16), ("SIDE", 5), ("SMALL", 4), ("GATHER", 50)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): rng.choice([1, 2, 30, 400, 5000]) for _ in range(500)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert collected(spelling.spelling_variants(table, parts)) == plain_variants(words)


def test_odd_words(spark):
    long = "q" * 60_000
    rows = [(None, 3), (None, None), ("", 4), ("a", 5), ("ab", 70), ("ab", 1), (long, 1), (long + "q", 50), (long[:-1] + "r", 2), ("x" * 9, None)]
    got = collected(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == {
        None: (None, None, 3, 0, None), "": (None, "", 4, 0, None), "a": ("ab", "ab", 5, 1, 71), "ab": (None, "ab", 71, 1, None), "x" * 9: (None, "x" * 9, 0, 0, None),
        long: (long + "q", long + "q", 1, 2, 50), long + "q": (None, long + "q", 50, 1, None), long[:-1] + "r": (None, long[:-1] + "r", 2, 1, None),
    }
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(empty)).count() == 0
    docs = spark.createDataFrame([(None, "Anythin anything ANYTHING"), (1, None), (1, "anything"), (1, "anything")], "doc_id long, text string")
    assert collected(spelling.spelling_variants(spelling.word_counts(docs, every=10**12))).keys() == {"anything"}
