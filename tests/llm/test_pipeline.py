"""The pipeline's stages on the smallest tables."""

import pyarrow as pa

import corpus_pipeline
from galewatch.llm import ngram_join, pieces

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    good, single, clean, mixed, encoded = seen[1:]
    assert 0 < good.count() < docs.count()
    groups = ngram_join.near_duplicate_groups(good)
    assert single.count() == groups.select("component_id").distinct().count()
    assert clean.count() == single.count() and clean.where("text rlike '[a-z0-9]@[a-z0-9]+[.]example'").count() == 0
    assert mixed.select("doc_id").distinct().count() == clean.count() <= mixed.count()
    assert encoded.count() == mixed.count() and encoded.where("n_tokens = 0 and n_chars > 0").count() == 0


def test_last_stage_has_the_places_of_pieces_and_the_decoded_text(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_path("piece_bpe_32k.model"))
    texts = ["One text, twice  spaced.", "caf\u00e9 \U0001f389 \u2581 mark", "", None, " tab\tand line\n"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, df, DATA).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, data = got[i], (t or "").encode()
        assert r.ids == model.encode(t or "") and r.decoded == model.decode(r.ids)
        assert len(r.begins) == len(r.ends) == len(r.ids) == r.n_tokens
        assert b"".join(data[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == data


def test_workers_keep_no_words_after_encoding(spark):
    path = corpus_pipeline.tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, f"word{i} other{i}", "en", "s", 10) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.encode(spark, df, DATA).where("n_tokens > 0").count() == 200

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [len(pieces._encoder(path, None).known)]})

    assert [r.n for r in df.repartition(8).select("doc_id").mapInArrow(held, "n long").collect()] == [0] * 8


def test_join_sends_few_rows_at_once_and_gives_the_setting_back(spark, monkeypatch):
    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram_join.map_arrow

    def spy(df, run, schema):
        seen.append(int(spark.conf.get(key)))
        return real(df, run, schema)

    monkeypatch.setattr(ngram_join, "map_arrow", spy)
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(i, f"{text} end{i % 2}") for i in range(6)], "doc_id long, text string")
    before = spark.conf.get(key)
    assert {r.component_id for r in ngram_join.near_duplicate_groups(df).collect()} == {0}
    assert len(seen) >= 4 and max(seen) <= ngram_join.ROWS and spark.conf.get(key) == before
