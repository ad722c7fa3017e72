"""Nulls, repeated rows, empty tables and names that clash, for operators and stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from galewatch.llm import common, mixing, ngram_join, pieces, pii, quality, queries, rules, url_filters

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "one two three four five six seven eight nine ten " * 4


@pytest.fixture(scope="module")
def odd(spark):
    """Null in every column, empty and long texts, repeated rows, two texts under one id."""
    rows = [(1, TEXT, "en", "a", 1), (1, TEXT, "en", "a", 1), (2, None, None, None, None), (None, TEXT + "x", "en", "b", 2), (3, "", "en", "b", 0)]
    rows += [(4, "write to a.b@mail.example or +1 (555) 123-4567", "de", "a", 3), (4, "other words under one id", "de", None, 3), (5, "z" * 200_000, "en", "a", 4), (6, "w " * 30_000, "en", "b", 4)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, None), (None, 1, 1), (5, None, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")


def test_names_that_clash(odd):
    clash = odd.withColumns({c: F.lit("own") for c in ("pass", "place", "_tokens", "_order", "_row", "_block", "_spans", "found_", "n_words", "_words", "upper_share")})
    mixed = mixing.mix_sources(clash, repetition=2.0)
    assert mixed.columns.count("pass") == mixed.columns.count("place") == 1 and {r[0] for r in mixed.select("_tokens").distinct().collect()} == {"own"}
    assert mixed.select("pass").schema[0].dataType.typeName() == "integer"
    stats = rules.with_statistics(clash)
    assert stats.columns.count("n_words") == 1 and stats.agg(F.max("n_words")).first()[0] == 30_000
    spans = pii.find_spans(clash)
    assert {r[0] for r in spans.select("_spans").distinct().collect()} == {"own"} and spans.where("size(found) > 0").count() == 1


def test_repeated_and_null_rows_are_each_returned(odd, labels):
    n = odd.count()
    assert quality.classify_quality(odd, labels).count() == n
    assert rules.apply_rules(odd, labels).count() == n
    assert pii.find_spans(odd).count() == n
    groups = ngram_join.near_duplicate_groups(odd).collect()
    assert len(groups) == n and [r.component_id for r in groups if r.doc_id == 1] == [1, 1] and {r.n_shingles for r in groups if r.doc_id in (2, 3)} == {0}
    encoded = pieces.encode_documents(odd, queries.tokenizer_path("piece_bpe_32k.model"), keep=("doc_id",))
    assert encoded.count() == n and encoded.where("size(ids) = 0").count() >= 2
    mixed = mixing.mix_sources(odd, repetition=2.0)
    assert mixed.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and mixed.where("pass = 0").count() == n


def test_ties_have_one_order(odd):
    twice = [mixing.mix_sources(odd.repartition(k), repetition=2.0).select("doc_id", "source", "pass", "place") for k in (1, 3)]
    assert sorted(map(str, twice[0].collect())) == sorted(map(str, twice[1].collect()))


def test_stages_on_odd_and_empty_tables(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns) or name.startswith("SentencePiece")
            kept = out.count()
            assert kept <= 2 * rows.count() and (kept > 0 or rows is not odd)


def test_pages_without_urls_hosts_or_html(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no host", ""), (2, "no host", ""), (3, "http://A.ORG/x", "<a href='//b.net'>"), (4, "http://b.net", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.org", "/x", "org/", "allow") and got[4][:3] == ("b.net", "", None)
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_scratch_tables_go(spark):
    made = common.persist_table(spark.range(3))
    files = made.inputFiles()
    common.drop_table(made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(files[0]).count()
    assert common.free_name("a", spark.createDataFrame([(1, 2)], "A int, a_ int")) == "a__"


def test_substring_dedup_leaves_no_shuffle_files_and_no_dealt_items(spark):
    import glob

    from galewatch.llm import common, substring_dedup

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    homes = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for h in homes for f in glob.glob(f"{h}/*/shuffle_*")}
    home = common.scratch_dir(spark).removeprefix("file:").replace("///", "/")
    before, tables, set_to = shuffles(), set(glob.glob(f"{home}/table-*")), spark.conf.get(key)
    # one passage in 40 documents, each with a word of its own in it: more than SMALL windows of one signature
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20)] + [f"own{i}" if k == i + 8 else f"w{k}" for k in range(60)])) for i in range(40)]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not shuffles() - before and spark.conf.get(key) == set_to
    left = [t for t in set(glob.glob(f"{home}/table-*")) - tables if "kind" in spark.read.parquet(t).columns]
    assert left and all(spark.read.parquet(t).where("kind = 1").isEmpty() for t in left)
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(40)) and {r.component_id for r in got} == {0}
    assert all(20 <= r.start and r.end <= 80 and r.end - r.start >= 50 for r in got)


def test_substring_dedup_compares_tiles_of_two_documents_once(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from galewatch.llm import substring_dedup

    seen, real = [], substring_dedup.persist_table

    def watched(df):
        made = real(df)
        if "entries" in made.columns and "mask" not in made.schema["entries"].dataType.elementType.names:  # the last comparison
            r = made.agg(F.count(F.lit(1)), F.countDistinct("doc_id", "other"), F.max(F.size("entries"))).first()
            seen.append(tuple(r))
        return made

    monkeypatch.setattr(substring_dedup, "persist_table", watched)
    rng, rows = random.Random(5), []
    for i in range(24):  # 134 starts of stretches in each: three tiles
        t = [f"w{k}" for k in range(183)]
        for at in range(20 + i, 183, 37):
            t[at] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(t)))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(24)) and {r.component_id for r in got} == {0}
    (pairs, different, most), = seen
    assert 0 < pairs == different and most <= 9  # windows in common: some dozens
