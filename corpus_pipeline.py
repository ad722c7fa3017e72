"""A corpus pipeline of five operators: from raw documents to token ids with their places in the text.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galewatch.llm import mixing, ngram_join, pieces, pii, quality
from galewatch.llm.common import persist_table, read_table, scratch_dir
from galewatch.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ranker = quality.learn(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_texts(docs, ranker).where(F.col("score") >= quality.KEEP_AT).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near duplicates.

    What goes is looked up by id (sent to all tasks while the ids are few, see ngram_join.few), so
    the texts themselves are not shuffled. Of rows that share an id one stays.
    """
    groups = persist_table(ngram_join.near_duplicate_groups(docs))
    gone = persist_table(groups.where("component_id <> doc_id").select("doc_id").distinct())
    again = persist_table(groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    kept = docs.join(ngram_join.few(gone)[0], "doc_id", "left_anti").select(*COLUMNS)
    single = kept.join(ngram_join.few(again)[0], "doc_id", "left_anti")
    repeated = kept.join(ngram_join.few(again)[0], "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text."""
    found = pii.find_spans(docs.withColumn("_text", F.coalesce("text", F.lit(""))), "_text")
    clean = found.withColumn("text", F.when(F.size("found") > 0, pii.redact(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature weights: every document once at least, those of small sources again."""
    return mixing.mix_sources(docs, repetition=1.5).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with the bytes of it that each piece covers, and the text that they decode to."""
    out = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source", "n_chars"))
    return out.select(
        "doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", "decoded", F.char_length("decoded").cast("long").alias("decoded_chars")
    )


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the learned stages; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared scratch folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
