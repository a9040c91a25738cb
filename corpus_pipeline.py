"""Corpus pipeline over ``documents``: five stages, each an operator of ``notewright.llm``.

1. language_id (5): documents whose text fits no language, or surely another one than they declare, go.
2. near_duplicates (3): five-word shingles at a similarity of 0.8; of each component the smallest doc_id stays.
3. secrets (7): found spans are masked in the text.
4. mix (6): a row for each pass that the mix makes over a document, with the words it takes.
5. encode (4): piece ids of every row; the last stage, so it returns its own columns.

A null text passes the first three stages as it is and gets no row from the mix, which takes no words of it. Repeated rows
are copies: one stays. Extra columns of documents are carried to the mix; a column ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import jaccard, langid, mixing, secrets, spiece
from notewright.llm.common import batches_of, put_back, set_aside, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject. Rejections are few, and joined by id and text."""
    own = F.xxhash64("text")
    used = ("doc_id", "text")
    keyed = set_aside(docs, *used).withColumn("p_key", F.struct("doc_id", own.alias("h")))
    said = langid.identify_documents(docs.select(F.struct("doc_id", own.alias("h")).alias("doc_id"), "text", "lang", "source"))
    gone = said.filter("rejected").select(F.col("doc_id").alias("g_key")).distinct()
    same = (F.col("p_key.h") == F.col("g_key.h")) & F.col("p_key.doc_id").eqNullSafe(F.col("g_key.doc_id"))
    gone = store(gone, "pipeline-rejected")
    return keyed.join(F.broadcast(gone) if gone.count() <= 500_000 else gone, same, "left_anti").transform(put_back, docs, *used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.drop_near_duplicates(docs, k=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights, as rows of documents."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row of the mix, stored here so that its wide rows go through Python in small batches."""
    with batches_of(spark, 1_000):
        return store(spiece.encode(docs), "pipeline-encoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix),
    ("encode", encode),
]

#: Learned models, components and a seeded choice of blocks aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
