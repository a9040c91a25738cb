"""Filter interaction audit: what each filter of a chain removes, for every order in which the filters can be applied.

Every document becomes a mask (one bit for each filter that it fails). Equal masks of a part are one cell with its counts, so
the long form holds cells, not documents: each cell is unpivoted against the steps of every order, a running bit-or window over
the steps gives the filters that failed it earlier, conditional sums over the cells give a step's counts, and a window over all
orders of a filter gives its Shapley total.

The filters of ``FILTERS`` see the text, ``duplicate`` the whole table: a text that a smaller doc_id also has. It is found by
grouping hashes of texts (SHA-256), with partial sums before the shuffle, so a text that a third of all rows share is a few rows.

A null text is an empty one, a null part an empty string. A null doc_id has no labels, and its text is neither a duplicate nor
makes one. Repeated rows count each; those of the smallest doc_id are no duplicates of one another. A doc_id with several labels is
good (toxic) if one of them says so. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, words

#: Failure conditions over a whole text, in the order of their letters; E is ``duplicate``.
FILTERS = {
    "A": lambda t: F.size(words(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 50 * F.size(words(t)),
    "C": lambda t: 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > 2 * F.length(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}
DUPLICATE = "E"


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict = FILTERS) -> DataFrame:
    """One narrow row for each document: doc_id, part, key (hash of the text), mask (of ``filters``, first bit lowest), good, toxic."""
    t = F.coalesce("text", F.lit(""))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails(F.col("a_text")), 1 << i).otherwise(0))
    said = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("a_text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("a_text", 256)).alias("key"), mask.alias("mask"))
    # A null id would meet all others in one task of the join; it has no label, so it goes round it.
    known = rows.filter("doc_id is not null").join(said, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")
    return known.unionByName(rows.filter("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])


def cells(rows: DataFrame, duplicate: int = len(FILTERS)) -> DataFrame:
    """part, mask, n, good, toxic: the documents of ``masks`` summed, with bit ``duplicate`` set for texts that a smaller doc_id has.

    Equal texts have equal masks, so a (text, part) keeps the counts of its smallest doc_id and of all; the smallest over the parts
    decides which of them are no duplicates.
    """
    sums = lambda: [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    counts = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    each = rows.filter("doc_id is not null").groupBy("key", "part", "mask", "doc_id").agg(*counts)
    texts = each.groupBy("key", "part", "mask").agg(F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first"), *sums())
    # As many rows for a key as parts hold the text.
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("key")))
    fresh = F.col("first.doc_id") == F.col("least")
    parts = F.array(
        F.struct("mask", *[F.when(fresh, F.col(f"first.{c}")).otherwise(F.lit(0)).alias(c) for c in ("n", "good", "toxic")]),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << duplicate)).alias("mask"), *[F.when(fresh, F.col(c) - F.col(f"first.{c}")).otherwise(F.col(c)).alias(c) for c in ("n", "good", "toxic")]),
    )
    both = texts.select("part", F.inline(parts)).filter("n > 0").unionByName(rows.filter("doc_id is null").groupBy("part", "mask").agg(*counts))
    return both.groupBy("part", "mask").agg(*sums())


def interactions(c: DataFrame, letters: str) -> DataFrame:
    """The long form's metrics of cells: one row for each part, order of ``letters`` and step.

    The rows made are parts x cells of a part (at most 2^k) x k! x k steps, whatever the number of documents.
    """
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(letters)])
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    steps = c.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("pos", "letter"))
    steps = steps.withColumn("fails", F.col("mask").bitwiseAND(bit(F.col("letter"))))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    fails, fresh = F.col("fails") != 0, F.col("earlier") == 0
    out = steps.groupBy("part", "filter_order", (F.col("pos") + 1).cast("int").alias("step"), "letter").agg(
        total(fresh & ~fails).alias("kept"), total(fresh & fails).alias("removed"), total(fails & ~fresh).alias("redundant"),
        total(fails & (F.col("mask") == F.col("fails"))).alias("unique_fails"), total(fresh & fails, "good").alias("good_lost"), total(fresh & fails, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters: dict = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of ``filters`` and of duplicates."""
    rows = store(masks(docs, labels, part, filters), "audit-masks")
    return interactions(cells(rows, len(filters)), "".join(filters) + DUPLICATE)
