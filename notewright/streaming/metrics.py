"""Metric buckets over events, the same for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_rates(events: DataFrame, width: str, seconds: int, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total, rate) per tumbling window; ``late`` sets a watermark on a stream, after which state goes."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"), F.round(F.col("n") / seconds, 9).alias("rate"))


def exposition(totals: DataFrame, prefix: str = "notewright") -> DataFrame:
    """Counters in the text format that scrapers read: one line per metric of (name, help, value)."""
    line = F.concat(F.lit(f"# HELP {prefix}:"), "name", F.lit(" "), "help", F.lit(f"\n# TYPE {prefix}:"), "name", F.lit(f" counter\n{prefix}:"), "name", F.lit(" "), F.col("value").cast("string"))
    return totals.select(line.alias("text"))
