"""Substring dedup by sliding sentence spans.

A text is cut into sentences (up to a run of ``.``, ``!``, ``?`` or a newline, with the white space after it). A sentence of
at least w = ``chop`` // 2 words is cut further by content, into pieces of at most w words that count as sentences: before each word
whose three-word hash is the least of w neighbours (the last of equal ones). Whatever comes before or after a shared passage,
its cuts are the same but for w words at its start and w + 2 at its end, so with the defaults every passage
of 50 words is found, wherever it starts and ends in a sentence.

A piece goes when it is covered by a run of two or more consecutive pieces, of ``min_words`` words or more, that has an equal run (words
in lower case) earlier, by doc_id and place; ``min_words=0`` takes every run. The hashes of all such runs aren't needed for that, only of
the shortest ones: from every piece the shortest run that qualifies, and up to every piece the shortest. Proof: let R be a run that
qualifies and has an equal run earlier, q its last piece, and s the last piece from which the shortest run ends in R (there is one: the shortest
run from R's first piece ends in R). A piece of R up to s lies in the shortest run from itself, which ends no later than that from s; a piece
behind s lies in the shortest run up to q, which is that from s to q. Both lie in R, so each has an equal run earlier.
As the shortest runs are runs themselves, nothing else goes. Runs are stored if another may equal them (a filter of at most
2^``most_bits`` bits tells; what it can't tell apart costs disk, not results) and joined over all documents.

A null text is an empty one; rows without a doc_id come after all others, told apart by 128 bits of a hash of their text. Rows that repeat a
doc_id with the same text are one document (twins are treated alike); with another text they are compared like any two documents. Ids of
any size pass unchanged. Empty tables give an empty result; other columns are ignored. Runs are told apart by 96 bits of a hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import batches_of, broadcast_if_small, discard, store

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n][.!?\s]*|[^.!?\n]+")
WORD = re.compile(r"\S+")
LAST = 2**63 - 1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


HASHES = _Hashes()


def cuts(w: list[str], lengths: list[int], span: int) -> list[int]:
    """Places before which sentences (their words in a row, ``lengths`` of them each, ``span`` at least) are cut inside.

    A cut is the least three-word hash of ``span`` neighbours of a sentence, the last of equal ones.
    """
    if len(HASHES) > 500_000:
        HASHES.clear()
    one = np.zeros(len(w) + 2, dtype=np.uint64)
    one[:-2] = [HASHES[x] for x in w]
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(w))
    h = one[:-2] * np.uint64(0x9E3779B97F4A7C15)
    h += np.where(left > 1, one[1:-1], 0) * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(left > 2, one[2:], 0) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = h >> np.uint64(24) << np.uint64(24) | (np.uint64(2**24 - 1) - np.arange(len(w), dtype=np.uint64) % np.uint64(2**24))
    width = 1
    while width < span:
        step = min(width, span - width)
        h, width = np.minimum(h[:-step], h[step:]), width + step
    windows = np.flatnonzero(left[: len(h)] >= span)
    least = (2**24 - 1 - (h[windows] & np.uint64(2**24 - 1)).astype(np.int64) - windows) % 2**24 + windows
    flag = np.zeros(len(w), dtype=bool)
    flag[least] = True
    flag[ends[:-1]] = flag[0] = False
    return np.flatnonzero(flag).tolist()


def sentences(text: str, chop: int, with_ends: bool = True) -> tuple[list[int], list[str], list[int]]:
    """Ends (code points; without ``with_ends`` only their number counts) of the pieces, which cover the text, their words in lower case, and how many."""
    ends, keys, counts, at, span = [], [], [], 0, max(1, chop // 2)
    split = [(s, s.lower().split()) for s in SENTENCE.findall(text)]
    long = [w for _, w in split if len(w) >= span]
    places, i, gone = cuts([x for w in long for x in w], [len(w) for w in long], span) if long else [], 0, 0
    for s, w in split:
        n, first = len(w), i
        if n >= span:
            while i < len(places) and places[i] < gone + n:
                i += 1
        if i > first:
            starts = [m.start() for m in WORD.finditer(s)] if with_ends else [0] * n
            x = 0
            for y in places[first:i]:
                y -= gone
                ends.append(at + starts[y])
                keys.append(" ".join(w[x:y]))
                counts.append(y - x)
                x = y
            w = w[x:]
        ends.append(at + len(s))
        keys.append(" ".join(w))
        counts.append(len(w))
        at += len(s)
        if n >= span:
            gone += n
    return ends, keys, counts


def runs(counts: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs from and up to every piece with words."""
    full = [i for i, n in enumerate(counts) if n]
    out, total, j = set(), 0, 0
    for a in range(len(full)):  # the shortest from full[a]
        j = max(j, a)
        while j < len(full) and (total < min_words or j - a < 2):
            total += counts[full[j]]
            j += 1
        if total < min_words or j - a < 2:
            break
        out.add((full[a], full[j - 1]))
        total -= counts[full[a]]
    total, a = 0, 0
    for j in range(len(full)):  # the shortest up to full[j]
        total += counts[full[j]]
        while j - a >= 2 and total - counts[full[a]] >= min_words:
            total -= counts[full[a]]
            a += 1
        if total >= min_words and j - a >= 1:
            out.add((full[a], full[j]))
    return out


def _hashed(batches: Iterator[pa.RecordBatch], min_words: int, chop: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A slice of 512 rows at most, and of its runs the row's number, the place and the two halves of the hash."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            part = whole.slice(lo, 512)
            rows, places, digests = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                _, keys, counts = sentences(text, chop, False)
                for a, b in runs(counts, min_words):
                    rows.append(i)
                    places.append(a << 24 | b - a)
                    digests.append(xxhash.xxh3_128_digest(" ".join(keys[a : b + 1]).encode("utf-8", "replace")))
            yield part, np.array(rows, dtype=np.int64), np.array(places, dtype=np.int64), np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)


def _all_runs(min_words: int, chop: int):
    """The runs of each document in three lists, so that texts are cut once for the filter and the runs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, places, h in _hashed(batches, min_words, chop):
            edges = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (places, h[:, 0].copy(), (h[:, 1] >> 32).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("did"), part.column("tk"), *lists], ["did", "tk", "place", "h1", "h2"])

    return emit


def _taken(bits: int):
    """The task's slots of the filter, once and more often taken."""
    low = min(16, bits)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        chunk, offset = slots >> low, (slots & (2**low - 1)).astype(np.uint16)
        edges = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
        pairs = list(zip(edges[:-1], edges[1:], strict=True))
        ones, twos = [offset[x:y].tobytes() for x, y in pairs], [offset[x:y][counts[x:y] > 1].tobytes() for x, y in pairs]
        return pa.RecordBatch.from_arrays([pa.array(chunk[edges[:-1]], pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["chunk", "ones", "twos"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            h, _ = jaccard._flat(b.column("h1"))
            if len(h):
                held.append(jaccard._slots(h.copy(), bits))
                n += len(h)
            if n > 2_000_000:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return emit


def _spans(shared, bits: int):
    """The runs that another may equal, a row each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offsets = jaccard._flat(b.column("h1"))
            if not len(h):
                continue
            keep = jaccard.shared_tokens(h.copy(), shared.value, bits)
            at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(offsets))[keep])
            columns = [b.column("did").take(at), b.column("tk").take(at), *[pa.array(jaccard._flat(b.column(c))[0][keep]) for c in ("place", "h1", "h2")]]
            yield pa.RecordBatch.from_arrays(columns, ["did", "tk", "place", "h1", "h2"])

    return emit


def _clean(chop: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, totals, gone, spans = [], [], [], []
            for text, places in zip(part.column("text").to_pylist(), part.column("places").to_pylist(), strict=True):
                ends, _, counts = sentences(text or "", chop, places is not None)
                total = sum(1 for n in counts if n)
                if places is None:
                    ends = [len(text)] if text else []
                drop = np.zeros(len(ends), dtype=bool)
                for p in places if places is not None else []:
                    drop[p >> 24 : (p >> 24) + (p & 0xFFFFFF) + 1] = True
                out, said, at, n = [], [], 0, 0
                for i, end in enumerate(ends):
                    if drop[i]:
                        n += counts[i] > 0
                        if said and said[-1][1] == at:
                            said[-1][1] = end
                        else:
                            said.append([at, end])
                    else:
                        out.append(text[at:end])
                    at = end
                texts.append(text if text is None else "".join(out))
                totals.append(total)
                gone.append(n)
                spans.append(",".join(f"{a}:{b}" for a, b in said))
            columns = [part.column("doc_id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_sentences", "n_removed", "removed"])

    return apply


def dedup_spans(docs: DataFrame, min_words: int = 25, chop: int = 25, most_bits: int = 28) -> DataFrame:
    """doc_id, text without the pieces of non-first runs, n_sentences and n_removed (pieces with words), removed (``start:end`` in code points, joined by commas)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # tk tells rows apart that have no doc_id of their own: none at all, or one that rows with other texts have too
    several = d.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("x"), F.max(F.md5("text")).alias("y"))
    several = store(several.filter("n > 1 and not (x <=> y)").select(F.col("doc_id").alias("s_id")), "spans-several")
    d = d.join(broadcast_if_small(several, 1_000_000), F.col("doc_id") == F.col("s_id"), "left")
    d = d.withColumn("tk", F.when(F.col("doc_id").isNull() | F.col("s_id").isNotNull(), F.md5(F.coalesce("text", F.lit("")))))
    d = d.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("did"), "tk")
    texts = d.select("did", "tk", "text").filter("text is not null")
    chars = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    bits = max(10, min(most_bits, (chars // 3).bit_length()))
    low = min(16, bits)
    slots = np.zeros((2 ** (bits - low), 2**low // 8), dtype=np.uint8)
    lists = "did long, tk string, place array<long>, h1 array<long>, h2 array<int>"
    every = store(texts.mapInArrow(_all_runs(min_words, chop), lists), "spans-every")
    with batches_of(docs.sparkSession, 1_000):
        taken = store(every.select("h1").mapInArrow(_taken(bits), "chunk long, ones binary, twos binary"), "spans-taken")
    for r in taken.groupBy("chunk").applyInPandas(jaccard._shared_slots(low), "chunk long, bits binary").toLocalIterator():
        slots[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(slots.reshape(-1))
    discard(taken)
    with batches_of(docs.sparkSession, 1_000):
        spans = store(every.mapInArrow(_spans(shared, bits), "did long, tk string, place long, h1 long, h2 int"), "spans-runs")
    discard(every)
    at = F.struct("did", "tk", "place")
    first = spans.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = store(first.filter("first < last").select("h1", "h2", "first"), "spans-first")
    later = spans.join(first, ["h1", "h2"]).filter(at > F.col("first")).select("did", "tk", "place")
    flags = later.groupBy(F.col("did").alias("f_did"), F.col("tk").alias("f_tk")).agg(F.collect_set("place").alias("places"))
    d = d.join(flags, (F.col("did") == F.col("f_did")) & F.col("tk").eqNullSafe(F.col("f_tk")), "left")
    return d.select("doc_id", "text", "places").mapInArrow(_clean(chop), "doc_id long, text string, n_sentences long, n_removed long, removed string")
