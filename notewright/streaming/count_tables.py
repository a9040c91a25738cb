"""N-gram tables that a stream keeps up to date: a table is a base and the deltas of batches, each under its batch's number.

A batch's counts are written under its number, in place of whatever an earlier attempt at it left, so a batch that is played again changes
nothing. ``compact`` adds the deltas up to a number into a new base, which counts only once it is whole; deltas that a base holds are never
read or written again. So there is no state but files, and any step can be lost and repeated. Numbers of batches rise; gaps are allowed.

Tables of three lives share the form: the context of one run, the dynamic table that runs are folded into, the static one of a corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ngrams
from ..session import _path

SCHEMA = "n int, ngram string, next_token string, cnt long"


def _whole(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Number -> folder of the finished folders ``prefix``<number> of ``path``."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    out = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(prefix) and fs.exists(_path(spark, f"{path}/{name}/_SUCCESS")[0]):
            out[int(name[len(prefix) :])] = f"{path}/{name}"
    return out


def _base(spark: SparkSession, path: str) -> tuple[int, str | None]:
    found = _whole(spark, f"{path}/base", "upto=")
    return max(found.items(), default=(-1, None))


def upsert(counts: DataFrame, number: int, path: str) -> bool:
    """Adds a batch's (n, ngram, next_token, cnt) under its number; does nothing if the base holds it already."""
    spark = counts.sparkSession
    if number <= _base(spark, path)[0]:
        return False
    rows = counts.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in SCHEMA.split(", "))])
    rows.write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
    return True


def _parts(spark: SparkSession, path: str, upto: int | None) -> tuple[list[str], int, list[str]]:
    """(folders to add up, the last number in them, deltas among them)."""
    held, base = _base(spark, path)
    deltas = {k: v for k, v in _whole(spark, f"{path}/deltas", "batch=").items() if k > held and (upto is None or k <= upto)}
    return [*([base] if base else []), *deltas.values()], max([held, *deltas]), list(deltas.values())


def read(spark: SparkSession, path: str) -> DataFrame:
    """(n, ngram, next_token, cnt) of all batches; an unknown path is an empty table."""
    parts = _parts(spark, path, None)[0]
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return ngrams.merge(spark.read.schema(SCHEMA).parquet(*parts))


def compact(spark: SparkSession, path: str, upto: int | None = None) -> int:
    """Adds the deltas up to a number (all, if None) into a new base and deletes what it holds; returns the base's number."""
    parts, last, deltas = _parts(spark, path, upto)
    if deltas:
        ngrams.merge(spark.read.schema(SCHEMA).parquet(*parts)).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    for folder in _whole(spark, f"{path}/base", "upto=").items():
        if folder[0] < last:
            p, fs = _path(spark, folder[1])
            fs.delete(p, True)
    for number, folder in _whole(spark, f"{path}/deltas", "batch=").items():
        if number <= last:
            p, fs = _path(spark, folder)
            fs.delete(p, True)
    return last


def fold(spark: SparkSession, source: str, into: str, run: int) -> bool:
    """Adds a run's context table into a dynamic one, under the run's number."""
    return upsert(read(spark, source), run, into)


def follow(stream: DataFrame, tokens: str, path: str, checkpoint: str, n_max: int = 4, n_min: int = 1, every: int = 16, **trigger) -> StreamingQuery:
    """Counts the n-grams of a stream's token arrays into ``path``, compacting after ``every`` batches. ``trigger`` as in writeStream.trigger."""

    def batch(d: DataFrame, number: int) -> None:
        upsert(ngrams.counts(d, tokens, n_max, n_min), number, path)
        if number % every == every - 1:
            compact(d.sparkSession, path, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
