"""Shared pieces of the training-data operators: word splitting, shared-folder tables (``store``), safe broadcasts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard  # noqa: F401
from ..session import materialise as store  # noqa: F401

#: White space of every contract: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, leaving every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f's lambdas use it for every element of another array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def set_aside(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with the columns of ``own`` and all others in one struct, other_columns: whatever the others are called, they can't meet an operator's."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in own]
    return docs.select(*[c for c in own if c in docs.columns], (F.struct(*rest) if rest else F.lit(None)).alias("other_columns"))


def put_back(d: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` in their order, those of ``own`` from ``d`` and the others from its struct."""
    return d.select(*[F.col(c) if c in own else F.col(f"other_columns.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if a count shows at most ``rows`` rows; beyond that a shuffle join does the same work.

    Call it on stored tables: the count is then read from the files' footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is stored meanwhile: wide rows then take little memory in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
