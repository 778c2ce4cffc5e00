"""Registered queries of the training-data operators 1 to 10 and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, mixing, ngram_join, pii, quality, sharding, token_counts, toxicity
from .common import table, text_of

TOKEN_LIMIT = 4096


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_words", "kind")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity, op2_ngram_join, op3_decontaminate, op4_mix_sources, op5_license_scan, op6_shard, op7_token_counts,
    op8_personal_data, op9_host_quality, op10_language_id, pipeline)}
