"""Registered queries of the corpus operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints, infilling, mixing, ngram_join, oracles, pieces, pii, quality, reply_trees, rules, spelling, substring_dedup,
    token_counts, url_filters,
)
from .common import read_table, sha256_hex


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["base"])
    of_kind = lambda i: lambda x: x["base"] & (x["kind"] == i)
    kinds = [F.size(F.filter("found", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *kinds, sha256_hex(pii.listing(base)).alias("base_sha256"), pii.listing(F.col("found")).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.tokens_by_section(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, repetition=2.0).select("doc_id", "source", "pass", "place")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    paths = reply_trees.format_paths(reply_trees.as_chains(turns.unionByName(more), "conv_id", "turn"))
    return reply_trees.digests(paths).withColumnRenamed("tree", "conv_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(back).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_document_fingerprints, op2_sentencepiece, op3_quality_classifier, op4_pii,
        op5_token_counts, op6_substring_dedup, op7_quality_rules,
        op8_mix_sources, op9_ngram_jaccard_join, op10_url_filters,
        op11_chat_formatting, op12_fill_in_middle, op13_spelling_variants,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_ngram_jaccard_join": oracles.NGRAM_GROUPS, "op10_url_filters": oracles.URL_VERDICTS,
        "op11_chat_formatting": oracles.CHATS, "op12_fill_in_middle": oracles.INFILLS,
    }
