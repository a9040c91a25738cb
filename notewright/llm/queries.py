"""The thin queries of the operators, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, fim, jaccard, langid, mixing, oracles, puquality, quality, secrets, sentspans, spiece, toxicity


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_learned_partitions(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(_read(spark, d, "embeddings").select("vec_id", "embedding"))


def op2_divergence_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(_read(spark, d, "documents").select("doc_id", "text", "lang"))


def op3_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.components(_read(spark, d, "documents"), k=3, percent=90).drop("tkey")


def op4_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return spiece.encode(_read(spark, d, "documents"))


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify_pages(_read(spark, d, "pages")).select("page_id", "declared", "host", "n_grams", "text_lang", "lang", "confidence", "rejected")


def op6_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_read(spark, d, "documents").select("doc_id", "text", "source"))


def op7_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.scan(_read(spark, d, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "labels").select("doc_id", "toxic"))


def op9_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return sentspans.dedup_spans(_read(spark, d, "documents").select("doc_id", "text"))


def op10_quotation_linking(spark: SparkSession, d: str) -> DataFrame:
    return chat.link_quotations(_read(spark, d, "conversations"))


def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit(_read(spark, d, "documents").select("doc_id", "text", "source"), _read(spark, d, "labels"))


def op12_pu_quality(spark: SparkSession, d: str) -> DataFrame:
    return puquality.score(_read(spark, d, "documents").select("doc_id", "text"), _read(spark, d, "labels").select("doc_id", "quality"))


def op13_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    return fim.digests(fim.transform(_read(spark, d, "documents").select("doc_id", "text")))


# What SQL can check of operators whose whole result it can't express.


def mix_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and targets of op6's plan; which words are taken is a seeded choice."""
    return op6_mix_sources(spark, d).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def secret_base_spans(spark: SparkSession, d: str) -> DataFrame:
    """op7's pattern spans; those of the models are learned."""
    return op7_secret_scan(spark, d).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_divergence_quality": op2_divergence_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_quotation_linking": op10_quotation_linking,
    "op11_filter_audit": op11_filter_audit,
    "op12_pu_quality": op12_pu_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
    "mix_targets": mix_targets,
    "secret_base_spans": secret_base_spans,
}

ORACLE: dict[str, str] = {
    "op2_divergence_quality": oracles.quality_sql(),
    "op3_jaccard_join": oracles.jaccard_sql(3, 90),
    "op11_filter_audit": oracles.audit_sql(),
    "op13_fill_in_middle": oracles.fim_sql(),
    "mix_targets": oracles.targets_sql(),
    "secret_base_spans": oracles.secrets_sql(),
}
