"""Sequence memory: cells (seq, cell, pos) with range edits, in batch form and as keyed state of a stream.

Ranges are half-open; a null or negative end is open. ``seq`` null means every sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(seq: int | None, p0: int | None, p1: int | None) -> Column:
    c = F.lit(True) if seq is None else F.col("seq") == seq
    if p0 is not None and p0 >= 0:
        c = c & (F.col("pos") >= p0)
    if p1 is not None and p1 >= 0:
        c = c & (F.col("pos") < p1)
    return c


def remove(cells: DataFrame, seq: int | None, p0: int | None, p1: int | None) -> DataFrame:
    return cells.filter(~_within(seq, p0, p1))


def keep(cells: DataFrame, seq: int) -> DataFrame:
    return cells.filter(F.col("seq") == seq)


def copy(cells: DataFrame, src: int, dst: int, p0: int | None = None, p1: int | None = None) -> DataFrame:
    """The cells of the range join ``dst`` as well, once."""
    add = cells.filter(_within(src, p0, p1)).withColumn("seq", F.lit(dst).cast(dict(cells.dtypes)["seq"]))
    return cells.unionByName(add).distinct()


def shift(cells: DataFrame, seq: int | None, p0: int | None, p1: int | None, by: int) -> DataFrame:
    """Moves the positions of the range; cells that fall below 0 go."""
    moved = F.when(_within(seq, p0, p1), F.col("pos") + by).otherwise(F.col("pos"))
    return cells.withColumn("pos", moved).filter("pos >= 0")


def divide(cells: DataFrame, seq: int | None, p0: int | None, p1: int | None, by: int) -> DataFrame:
    return cells.withColumn("pos", F.when(_within(seq, p0, p1), F.floor(F.col("pos") / by)).otherwise(F.col("pos")))


def bounds(cells: DataFrame) -> DataFrame:
    """(seq, pos_min, pos_max)."""
    return cells.groupBy("seq").agg(F.min("pos").alias("pos_min"), F.max("pos").alias("pos_max"))


def window_keep(cells: DataFrame, n: int) -> DataFrame:
    """Cells within the last n positions of their sequence."""
    return cells.withColumn("x_m", F.max("pos").over(Window.partitionBy("seq"))).filter(F.col("x_m") - F.col("pos") < n).drop("x_m")


def chunk_keep(cells: DataFrame, n: int) -> DataFrame:
    """Cells of the chunk of n positions that holds the sequence's last one."""
    return cells.withColumn("x_m", F.max("pos").over(Window.partitionBy("seq"))).filter(F.col("pos") >= F.floor(F.col("x_m") / n) * n).drop("x_m")


def context_shift(cells: DataFrame, n_ctx: int, n_keep: int, n_discard: int | None = None) -> DataFrame:
    """Sequences that fill the context keep their first cells, drop the next (half of the rest unless given), and move the later ones down."""
    c = cells.withColumn("x_n", F.count("*").over(Window.partitionBy("seq")))
    drop = F.lit(n_discard).cast("long") if n_discard else F.floor((F.col("x_n") - n_keep) / 2)
    c = c.withColumn("x_d", F.when(F.col("x_n") >= n_ctx, drop).otherwise(F.lit(0).cast("long")))
    c = c.filter((F.col("pos") < n_keep) | (F.col("pos") >= n_keep + F.col("x_d")))
    return c.withColumn("pos", F.when(F.col("pos") >= n_keep + F.col("x_d"), F.col("pos") - F.col("x_d")).otherwise(F.col("pos")).cast("long")).drop("x_n", "x_d")


def running_sequences(stream: DataFrame, last_n: int = 64) -> DataFrame:
    """(seq, n, last) after each micro-batch: cells seen, and the sum of the last ``last_n`` tokens kept as bounded state.

    Input (seq, pos, token); state per sequence is a count and a ring of tokens.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, ring = state.get if state.exists else (0, [])
        ring = list(ring)
        for pdf in batches:
            pdf = pdf.sort_values("pos")
            n += len(pdf)
            ring = (ring + pdf["token"].tolist())[-last_n:]
        state.update((n, ring))
        yield pd.DataFrame({"seq": [key[0]], "n": [n], "last": [int(sum(ring))]})

    return stream.groupBy("seq").applyInPandasWithState(step, "seq long, n long, last long", "n long, ring array<long>", "update", GroupStateTimeout.NoTimeout)
