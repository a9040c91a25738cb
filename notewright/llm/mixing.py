"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are dealt into shards of bounded size by a seeded hash, ordered there by another
hash, and cut into blocks of ``block`` words. The number of blocks to take is apportioned twice by highest
quotients (votes / 1, 3, 5, ...): among sources, by their target words, and among the shards of a source,
by their words. A shard takes each of its blocks ``quota div blocks`` times, and ``quota mod blocks`` blocks,
picked by a seeded permutation, once more. Sources whose target is under 100 blocks are apportioned among themselves in
blocks a 16th as long (and so on, down to single words), so that a source of any size comes near its target.

Nulls: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null
doc_id is ordered by its text. Empty tables give an empty result. Repeated rows are separate documents. The
driver holds one row per source and one per shard (about ``shard_docs`` documents each), nothing per document.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, put_back, set_aside, store, words

SEED = 20_240
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, repeat: float = 2.0) -> list[float]:
    """Targets that share ``share`` x all sizes by weight, none above ``repeat`` x its own size.

    The excess of a source at its limit is shared again by weight among the others until none is above.
    """
    out, rest, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free and rest > 0:
        total = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / total > repeat * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
        rest -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë seats per entry, at most ``caps``; equal quotients go to the earlier entry.

    Starts from the rounded proportional share and moves single seats by highest (or lowest) quotient, which
    reaches the same seats as giving them out one by one.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    total = sum(votes)
    got = [min(c, int(v * seats / total + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    spare = seats - sum(got)
    if spare > 0:
        heap = [(-v / (2 * got[i] + 1), i) for i, v in enumerate(votes) if v > 0 and got[i] < caps[i]]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * got[i] - 1), -i) for i, v in enumerate(votes) if got[i] > 0]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def block_lengths(goal: list[float], block: int) -> list[int]:
    """The block of each source: ``block`` words, divided by 16 until its target has 100 of them or a block is one word."""
    out = []
    for g in goal:
        b = block
        while b > 1 and g < 100 * b:
            b = max(1, b // 16)
        out.append(b)
    return out


def seats(goal: list[float], lengths: list[int], words: list[list[int]], repeat: int) -> list[list[int]]:
    """Blocks to take of each shard of each source, apportioned among the sources with blocks of one length, then among a source's shards."""
    quotas = [0] * len(goal)
    blocks = [sum(-(-w // b) for w in ws) for ws, b in zip(words, lengths, strict=True)]
    for b in set(lengths):
        at = [i for i, x in enumerate(lengths) if x == b]
        for i, q in zip(at, apportion([goal[i] for i in at], round(sum(goal[i] for i in at) / b), [repeat * blocks[i] for i in at]), strict=True):
            quotas[i] = q
    out = []
    for ws, b, q in zip(words, lengths, quotas, strict=True):
        caps = [repeat * -(-w // b) for w in ws]
        out.append(apportion([float(w) for w in ws], q, caps) if sum(caps) else [0] * len(ws))
    return out


def _permutation(n: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation k -> (a k + b) mod n."""
    a = seed * 2_654_435_761 % n or 1
    while gcd(a, n) != 1:
        a = a % n + 1
    return a, seed * 40_503 % n


def plan(docs: DataFrame, block: int | None = None, shard_docs: int = 20_000, share: float = 1.5, repeat: int = 2, weights=WEIGHTS, seed: int = SEED):
    """(documents with size, source, shard and key; table of shards with quotas and block lengths)."""
    spark = docs.sparkSession
    d = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("h"), F.xxhash64(F.col("text"), F.lit(seed)).alias("t"),
    )
    d = store(d, "mix-docs")
    per = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("w")).collect()
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["w"]) for r in per]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share, repeat)
    block = block or min(4096, max(1, sum(sizes) // 65_536))
    rows = [(r["source"], r["w"], g, max(1, -(-r["n"] // shard_docs))) for r, g in zip(per, goal, strict=True)]
    schema = T.StructType([T.StructField("s_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.LongType())])
    src = store(spark.createDataFrame(rows, schema), "mix-sources")
    d = d.join(broadcast_if_small(src, 20_000), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    d = d.withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("w")).collect()
    shards.sort(key=lambda r: (r["source"] is None, r["source"] or "", r["shard"]))
    of: dict = {}
    for r in shards:
        of.setdefault(r["source"], []).append((r["shard"], int(r["w"])))
    lengths = block_lengths(goal, block)
    words_of = [[w for _, w in of[r["source"]]] for r in per]
    out = []
    for at, (r, b, quotas) in enumerate(zip(per, lengths, seats(goal, lengths, words_of, repeat), strict=True)):
        for (shard, w), m in zip(of[r["source"]], quotas, strict=True):
            n = max(1, -(-w // b))
            pa, pb = _permutation(n, seed + 7919 * at + shard)
            out.append((r["source"], shard, n, m // n, m % n, pa, pb, b))
    names = ["n_blocks", "every", "extra", "pa", "pb", "block"]
    schema = T.StructType([T.StructField("s_source", T.StringType()), T.StructField("s_shard", T.LongType())] + [T.StructField(x, T.LongType()) for x in names])
    return d, store(spark.createDataFrame(out, schema), "mix-shards")


def mix_blocks(docs: DataFrame, **kw) -> DataFrame:
    """Per document: size, source_size, target, and ``blocks``: its overlaps (start word, words, times taken) with the shard's blocks."""
    d, shards = plan(docs, **kw)
    w = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("c1", F.sum("size").over(w)).withColumn("c0", F.col("c1") - F.col("size"))
    d = d.join(broadcast_if_small(shards, 100_000), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    b = F.col("block")

    def overlap(k):
        lo, hi = F.greatest(k * b, F.col("c0")), F.least((k + 1) * b, F.col("c1"))
        times = F.col("every") + (F.pmod(k * F.col("pa") + F.col("pb"), F.col("n_blocks")) < F.col("extra")).cast("long")
        return F.struct((lo - F.col("c0")).alias("start"), (hi - lo).alias("words"), times.alias("times"))

    first, last = F.floor(F.col("c0") / b).cast("long"), F.floor((F.col("c1") - 1) / b).cast("long")
    none = F.array().cast("array<struct<start:bigint,words:bigint,times:bigint>>")
    return d.select("doc_id", "t", "size", "source", "source_size", "target", F.when(F.col("size") > 0, F.transform(F.sequence(first, last), overlap)).otherwise(none).alias("blocks"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    taken = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, x: acc + x["words"] * x["times"])
    return mix_blocks(docs, **kw).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each pass over a document.

    A pass takes the whole text where it takes all of its blocks, else the taken words joined by single
    spaces; n_chars follows. Documents of which nothing is taken have no row.
    """
    seed = kw.get("seed", SEED)
    key = ["m_doc", "m_t", "m_source"]
    took = mix_blocks(docs, **kw).select(F.col("doc_id").alias("m_doc"), F.col("t").alias("m_t"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("blocks").alias("m_blocks"))
    took = store(took.filter("m_size > 0"), "mix-taken")
    own = ("doc_id", "text", "source", "n_chars")
    d = set_aside(docs, *own).withColumn("d_t", F.xxhash64(F.col("text"), F.lit(seed)))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("d_t") == F.col("m_t")) & F.col("source").eqNullSafe(F.col("m_source"))
    if took.groupBy(*key).count().filter("count > 1").limit(1).count():  # repeated rows are told apart by a number
        took = took.withColumn("m_no", F.row_number().over(Window.partitionBy(*key).orderBy("m_blocks")))
        d = d.withColumn("d_no", F.row_number().over(Window.partitionBy("doc_id", "d_t", "source").orderBy("d_t")))
        same = same & (F.col("d_no") == F.col("m_no"))
    d = d.join(took.filter(F.exists("m_blocks", lambda x: x["times"] > 0)), same)
    most = F.array_max(F.transform("m_blocks", lambda x: x["times"]))
    d = d.withColumn("m_pass", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    d = d.withColumn("m_kept", F.filter("m_blocks", lambda x: x["times"] >= F.col("m_pass"))).filter(F.size("m_kept") > 0)
    whole = F.aggregate("m_kept", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]) == F.col("m_size")
    d = d.withColumn("m_words", F.when(~whole, words(F.col("text"))))
    part = F.array_join(F.flatten(F.transform("m_kept", lambda x: F.slice(F.col("m_words"), x["start"].cast("int") + 1, x["words"].cast("int")))), " ")
    text = F.when(whole, F.col("text")).otherwise(part)
    return put_back(d.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")), docs, *own)
