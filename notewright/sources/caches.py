"""Kept results: n-gram tables, importance matrices, and the audit rows of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ngrams import merge
from ..operators.stats import merge_activity


def save_counts(table: DataFrame, path: str) -> None:
    """An n-gram table (n, ngram, next_token, cnt) as Parquet, a folder for each order."""
    table.write.mode("overwrite").partitionBy("n").parquet(path)


def load_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """N-gram tables, several of them added up; a count below 1 is an error of the file."""
    parts = [spark.read.schema("ngram string, next_token string, cnt long, n int").parquet(p).select("n", "ngram", "next_token", "cnt") for p in paths]
    fine = [p.withColumn("cnt", F.when(F.col("cnt") > 0, F.col("cnt")).otherwise(F.raise_error(F.lit("an n-gram count below 1")).cast("long"))) for p in parts]
    return fine[0] if len(fine) == 1 else merge(*fine)


def save_activity(matrix: DataFrame, path: str) -> None:
    """An importance matrix (name, idx, sum_sq, n) as Parquet."""
    matrix.write.mode("overwrite").parquet(path)


def load_activity(spark: SparkSession, *paths: str) -> DataFrame:
    """Importance matrices, several of them added up."""
    parts = [spark.read.parquet(p) for p in paths]
    return parts[0] if len(parts) == 1 else merge_activity(*parts)


def run_parameters(spark: SparkSession, parameters: dict) -> DataFrame:
    """(name, value): the parameters of a run, values in JSON, in order of name."""
    rows = [(k, json.dumps(v, ensure_ascii=False, default=str)) for k, v in sorted(parameters.items())]
    return spark.createDataFrame(rows, "name string, value string")


def observed(d: DataFrame, name: str, text: str) -> tuple[DataFrame, Observation]:
    """``d`` and an observation of its rows, characters and empty texts, filled by whatever action runs over it: no second pass."""
    o = Observation(name)
    t = F.col(text)
    return d.observe(o, F.count(F.lit(1)).alias("rows"), F.sum(F.length(t)).alias("characters"), F.count_if(F.coalesce(t, F.lit("")) == "").alias("empty")), o


def write_run(d: DataFrame, text: str, path: str, parameters: dict, log: str) -> dict:
    """Writes a result as Parquet beside its audit table (parameters and what was observed); returns the observed values."""
    out, o = observed(d, "run", text)
    out.write.mode("overwrite").parquet(path)
    seen = dict(o.get)
    run_parameters(d.sparkSession, parameters | {f"observed.{k}": v for k, v in seen.items()}).coalesce(1).write.mode("overwrite").parquet(log)
    return seen
