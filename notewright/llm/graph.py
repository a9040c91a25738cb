"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.sum(F.xxhash64("v", "u") % 998_244_353).alias("t")).collect()[0]
    return r["n"], r["s"], r["t"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is the smallest node of its component.

    Every round is two aggregations and joins on small rows, written to the shared folder; the rounds grow with
    the log of the longest path. Null ends and loops are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct()
    e = store(e, "components")
    mark = _mark(e)
    for _ in range(most if mark[0] else 0):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        pairs = large.join(low, "v").select("u", "v", "m")
        small = pairs.filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(low.select(F.col("m").alias("u"), "v")).distinct()
        was_e, e = e, store(small, "components")
        was, mark = mark, _mark(e)
        discard(was_e)
        if mark == was:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
