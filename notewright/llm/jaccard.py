"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's tokens are 64-bit hashes of its distinct word shingles. All documents order their tokens alike: first those that no other
document holds (a filter of at most 2^``most_bits`` bits, a slot per token of the corpus while it has no more, tells them), then rare
ones, then frequent ones by their count. Frequent are tokens that stand out within tasks, at most ``most_frequent`` of them, with their
counts summed over the corpus. Filter and counts only shape the order, so what they can't tell apart costs time, not links. Two sets of n
and m tokens whose similarity reaches t share at least two tokens within the first n - ceil(t n) + 2 and m - ceil(t m) + 2 of them: the
prefixes, extended by one token. So a prefix is indexed by its single rare tokens, and by its pairs of frequent tokens; two documents
that share two tokens share a single rare one or a pair of frequent ones. A document whose prefix is all its own has no entry and no
partner. Sets of over 1200 / (100 - percent) tokens, whose prefixes would give too many pairs, index frequent tokens singly (those within t of
that size index both, as a partner may lie on either side of it). A set of one token is indexed by it.

Every document is first held against one document of each of its entries, the hub: the one with the smallest share of tokens of its own,
which is the most central of near copies. The components of those links are then contracted: only entries that still span several
components go on, and there the documents outside the entry's largest component meet those of all others. A pair is verified by its
sets only if sizes and parity bitmaps let it: the bitmaps of similar sets differ in no more bits than the sets do in tokens, so nothing is lost.

Documents with equal token sets (told by 128 bits of a hash) are one node, so copies aren't compared. A null or blank text has
no tokens and links with nothing. Rows with a null doc_id take part; a component's id is its smallest doc_id (null if it has
none). Rows that repeat are copies. An empty table gives an empty result. Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batches_of, broadcast_if_small, put_back, set_aside, store, words
from .graph import connected_components

MIX = np.uint64(0x9E3779B97F4A7C15)
PARITY_BITS = 1024


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, low (text with A-Z lowered) and tkey, a 128-bit hash of it."""
    return docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("tkey", F.md5("low"))


def shingled(d: DataFrame, k: int) -> DataFrame:
    """Adds h: distinct hashes of the k-word shingles; of a shorter text the whole sequence as one."""
    d = d.withColumn("w", words(F.col("low")))
    n = F.size("w")
    all_k = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])))
    one = F.array(F.xxhash64(F.lit("short"), F.array_join("w", " ")))
    h = F.when(n >= k, all_k).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))
    return d.withColumn("h", h).drop("w", "low")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) * MIX >> np.uint64(64 - bits)).astype(np.int64)


def set_key(h: np.ndarray) -> str:
    """128-bit hash of a set of tokens."""
    return xxhash.xxh3_128_hexdigest(np.sort(h).tobytes())


def _count(bits: int, often: int = 4):
    """Documents with their set's key and size; then the task's slots of the filter, once and more often taken, and those taken ``often``."""
    low = min(16, bits)
    names = ["doc_id", "tkey", "key", "n", "chunk", "ones", "twos", "slot", "cnt"]
    kinds = dict(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()], strict=True))

    def row(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, kinds[c]) for c in names], names)

    def taken(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        chunk, offset = slots >> low, (slots & (2**low - 1)).astype(np.uint16)
        edges = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        parts = [(int(chunk[x]), offset[x:y].tobytes(), offset[x:y][counts[x:y] > 1].tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        yield row(chunk=pa.array([p[0] for p in parts], pa.int64()), ones=pa.array([p[1] for p in parts], pa.binary()), twos=pa.array([p[2] for p in parts], pa.binary()))
        many = counts >= often
        if many.any():
            yield row(slot=pa.array(slots[many]), cnt=pa.array(counts[many].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            h, offsets = _flat(b.column("h"))
            keys = pa.array([set_key(h[x:y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield row(doc_id=b.column("doc_id"), tkey=b.column("tkey"), key=keys, n=pa.array(np.diff(offsets).astype(np.int64)))
            if len(h):
                held.append(_slots(h, bits))
                n += len(h)
            if n > 2_000_000:
                yield from taken(held)
                held, n = [], 0
        if n:
            yield from taken(held)

    return run


def _shared_slots(low: int):
    """Bits of a chunk: the slots taken more than once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(2**low, dtype=bool), np.zeros(2**low, dtype=bool)
        for ones, twos in zip(pdf["ones"], pdf["twos"], strict=True):
            i = np.frombuffer(ones, dtype=np.uint16)
            twice[i[once[i]]] = True
            once[i] = True
            twice[np.frombuffer(twos, dtype=np.uint16)] = True
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


def shared_tokens(h: np.ndarray, filter_bits: np.ndarray, bits: int) -> np.ndarray:
    """Whether another document may hold the token; where not, none does."""
    s = _slots(h, bits)
    return (filter_bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def parity(h: np.ndarray) -> np.ndarray:
    """Bitmap of PARITY_BITS in 64-bit words: bit i is the parity of the tokens that fall on it."""
    odd = np.bincount((h.view(np.uint64) >> np.uint64(17)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def filter_size(chars: int, most_bits: int) -> int:
    """Power of two of the filter's slots: one for each token of a text of so many characters."""
    return max(10, min(most_bits, (chars // 5).bit_length()))


def filter_file(chunks: DataFrame, bits: int) -> str:
    """Name of the file, known to all executors, with the shared slots of ``chunks`` (chunk, ones, twos); the driver holds one partition of them."""
    low = min(16, bits)
    path = os.path.join(tempfile.mkdtemp(prefix="notewright-"), f"filter-{uuid.uuid4().hex}")
    slots = np.memmap(path, dtype=np.uint8, mode="w+", shape=(2 ** (bits - low), 2**low // 8))
    for r in chunks.groupBy("chunk").applyInPandas(_shared_slots(low), "chunk long, bits binary").toLocalIterator():
        slots[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    slots.flush()
    chunks.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


class Order:
    """The common order of tokens: filter of shared slots (a file's name), and the frequent slots with their counts."""

    def __init__(self, name: str, bits: int, slots: np.ndarray, counts: np.ndarray):
        at = np.argsort(slots, kind="stable")
        self.name, self.bits, self.slots = name, bits, slots[at]
        self.levels = np.minimum(np.log2(counts[at] + 1) * 4, 127).astype(np.uint64)

    @cached_property
    def filter_bits(self) -> np.ndarray:
        return np.memmap(SparkFiles.get(self.name), dtype=np.uint8, mode="r")

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shared, level): level is 0 for rare tokens."""
        s = _slots(h, self.bits)
        shared = (self.filter_bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
        level = np.zeros(len(h), dtype=np.uint64)
        if len(self.slots):
            i = np.minimum(np.searchsorted(self.slots, s), len(self.slots) - 1)
            level = np.where(self.slots[i] == s, self.levels[i], level)
        return shared, level


def entries(h: np.ndarray, order: Order, percent: int, pairs_below: int) -> tuple[np.ndarray, float]:
    """Index entries of one set, single tokens and pairs of its extended prefix, and its share of tokens that no other document holds.

    Tokens that no other document holds come first in the order and need no entry.
    """
    n = len(h)
    shared, level = order.look(h)
    own = 1.0 - float(shared.sum()) / max(n, 1)
    if n < 2:
        return h[shared], own
    size = min(n, n - -(-percent * n // 100) + 2)
    if n - int(shared.sum()) >= size:
        return h[:0], own
    rank = level << np.uint64(56) | h.view(np.uint64) >> np.uint64(8) | np.where(shared, np.uint64(1 << 63), np.uint64(0))
    at = np.argpartition(rank, size - 1)[:size] if size < n else np.arange(n)
    at = at[shared[at]]
    tokens, often = h[at], level[at] > 0
    if not often.any():
        return tokens, own
    parts = [tokens[~often]]
    common = np.sort(tokens[often]).view(np.uint64)
    if n <= pairs_below:
        i, j = np.triu_indices(len(common), 1)
        parts.append(((common[i] * MIX) ^ (common[j] + (common[i] >> np.uint64(29)))).view(np.int64))
    if 100 * n >= percent * pairs_below:
        parts.append(common.view(np.int64))
    return np.concatenate(parts), own


def _index(order, percent: int, pairs_below: int):
    """key, n, own, bits, sigs of the task's different sets that have an entry."""
    lists = pa.list_(pa.int64())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = order.value, set()
        for b in batches:
            h, offsets = _flat(b.column("h"))
            out = []
            for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                mine = h[x:y]
                got, own = entries(mine, o, percent, pairs_below)
                if len(got) and (key := set_key(mine)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    out.append((key, len(mine), own, parity(mine), got))
            for lo in range(0, len(out), 100):
                keys, n, own, bits, sigs = zip(*out[lo : lo + 100], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64()), pa.array(own, pa.float64()), pa.array(bits, lists), pa.array(sigs, lists)], ["key", "n", "own", "bits", "sigs"])

    return emit


def _fits(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _alike(n: Column, m: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether parity bitmaps ``a`` and ``b`` of sets of n and m tokens let a link through."""
    differ = F.lit(0)
    for i in range(PARITY_BITS // 64):
        differ = differ + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return _fits(n, m, percent) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _verified(pairs: DataFrame, nodes: DataFrame, base: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of the ``pairs`` of nodes that are linked: those that the parity bitmaps let through, verified by their sets."""
    light = broadcast_if_small(nodes.select("id", "n", "bits"), 20_000)
    p = pairs.join(light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    p = p.join(light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    p = store(p.filter(_alike(F.col("na"), F.col("nb"), F.col("ba"), F.col("bb"), percent)).select("a", "b"), "jaccard-pairs")
    asked = p.select(F.col("a").alias("id")).union(p.select("b")).distinct().join(nodes.select("id", "key"), "id")
    reps = base.join(asked, "key").groupBy("id").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"))
    reps = broadcast_if_small(store(reps.select("id", F.col("rep.doc_id").alias("r_id"), F.col("rep.tkey").alias("tkey")), "jaccard-reps"), 500_000)
    d = keyed(docs).join(reps, "tkey").filter(F.col("doc_id").eqNullSafe(F.col("r_id"))).drop("doc_id", "r_id", "tkey")
    sets = store(shingled(d, k).dropDuplicates(["id"]), "jaccard-sets")
    a = sets.select(F.col("id").alias("a"), F.col("h").alias("ha"))
    b = sets.select(F.col("id").alias("b"), F.col("h").alias("hb"))
    j = p.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return store(j.filter(100 * F.col("both") >= percent * (F.size("ha") + F.size("hb") - F.col("both"))).select("a", "b"), "jaccard-links")


def _rest(ix: DataFrame, nodes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components of ``links`` that share an entry and whose bitmaps let a link through.

    Of each entry's largest component none meet each other. The bitmaps are part of the join, so that it makes no row for a pair that
    can't be linked.
    """
    at = store(connected_components(links), "jaccard-roots")
    ix = ix.join(at.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    ix = store(ix, "jaccard-contracted")
    per = ix.groupBy("sig", "root").agg(F.count("*").alias("c"))
    main = store(per.groupBy("sig").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("sig", F.col("m.root").alias("main")), "jaccard-open")
    ix = ix.join(main, "sig").join(nodes.select("id", "bits"), "id")
    ix = store(ix.select("sig", "id", "n", "root", "main", "bits"), "jaccard-open-entries")
    rest = ix.filter("root <> main").select("sig", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("root").alias("ri"), F.col("bits").alias("bi"))
    rest = rest.withColumnRenamed("sig", "si")
    near = (F.col("si") == F.col("sig")) & (F.col("ri") != F.col("root")) & _alike(F.col("ni"), F.col("n"), F.col("bi"), F.col("bits"), percent)
    return rest.join(ix, near).select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct()


def components(docs: DataFrame, k: int = 5, percent: int = 80, most_bits: int = 33, most_frequent: int = 2**18, frequent: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, tkey: one row per document; links are ``100 * intersection >= percent * union`` of k-word shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hashed = shingled(keyed(docs), k)
    chars = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    bits = filter_size(chars, most_bits)
    schema = "doc_id long, tkey string, key string, n long, chunk long, ones binary, twos binary, slot long, cnt long"
    with batches_of(spark, 500):
        table = store(hashed.select("doc_id", "tkey", "h").mapInArrow(_count(bits), schema), "jaccard-base")
    base = table.filter("key is not null").select("doc_id", "tkey", "key", "n")
    often = table.filter("slot is not null").groupBy("slot").agg(F.sum("cnt").alias("c")).filter(F.col("c") >= frequent)
    often = often.orderBy(F.desc("c"), "slot").limit(most_frequent).toPandas()
    name = filter_file(table.filter("chunk is not null").select("chunk", "ones", "twos"), bits)
    order = spark.sparkContext.broadcast(Order(name, bits, often["slot"].to_numpy(dtype=np.int64), often["c"].to_numpy(dtype=np.float64)))
    index = hashed.select("h").mapInArrow(_index(order, percent, 1200 // (100 - percent)), "key string, n long, own double, bits array<long>, sigs array<long>")
    with batches_of(spark, 500):
        index = store(index, "jaccard-index")
    nodes = store(index.dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()), "jaccard-nodes")
    ix = nodes.select(F.explode("sigs").alias("sig"), "id", "n", "own")
    hubs = ix.groupBy("sig").agg(F.min(F.struct("own", "id", "n")).alias("hub"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("sig", "hub")
    ix = store(ix.join(hubs, "sig").select("sig", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "jaccard-shared")
    first = ix.filter((F.col("id") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), percent)).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = _verified(first, nodes, base, docs, k, percent)
    more = _rest(ix.select("sig", "id", "n"), nodes, links, percent).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(_verified(more, nodes, base, docs, k, percent))
    at = connected_components(links).join(nodes.select(F.col("id").alias("node"), "key"), "node").select("key", "root")
    ids = base.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    linked = store(at.join(ids, "key"), "jaccard-roots")
    lows = broadcast_if_small(store(linked.groupBy("root").agg(F.min("low").alias("linked_low")), "jaccard-lows"), 200_000)
    ids = ids.join(linked.select("key", "root").join(lows, "root").select("key", "linked_low", F.lit(True).alias("is_linked")), "key", "left")
    ids = store(ids.select(F.col("key").alias("i_key"), F.when(F.col("is_linked"), F.col("linked_low")).otherwise(F.col("low")).alias("low")), "jaccard-ids")
    d = base.join(ids, base["key"] == ids["i_key"], "left")
    return d.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "tkey")


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, and one row of those that repeat it.

    Documents without words, and components without a doc_id, keep all their distinct rows.
    """
    c = store(components(docs, **kw), "jaccard-components")
    gone = c.filter("n_shingles > 0 and component_id is not null and (doc_id is null or doc_id <> component_id)").select(F.col("doc_id").alias("g_id"), F.col("tkey").alias("g_key")).distinct()
    twins = c.select("doc_id", "tkey")
    repeat = c.count() != twins.distinct().count()
    keys = set_aside(docs, "doc_id", "text").select("*", F.md5(ascii_lower(F.coalesce("text", F.lit("")))).alias("g_own"))
    kept = keys.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_own") == F.col("g_key")), "left_anti")
    return put_back(kept.dropDuplicates(["doc_id", "g_own"]) if repeat else kept, docs, "doc_id", "text")
