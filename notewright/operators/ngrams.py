"""N-gram next-token tables: counts, merges, drafts; acceptance statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between a window's tokens: sorts before every other character, so that equal beginnings stand together.
GAP = "\0"


def grams(d: DataFrame, tokens: str, n_max: int = 4, n_min: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(keep, n, ngram, next_token): every n-gram of tokens, space-joined, with the token behind it.

    A place of the text is one row with the next n_max tokens beside it; its n-grams are plain expressions on them.
    """
    t = F.col(tokens)
    shifted = F.arrays_zip(*[(t if k == 0 else F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0)))).alias(f"t{k}") for k in range(n_max + 1)])
    places = d.filter(F.size(t) > n_min).select(*(keep or []), F.explode(shifted).alias("x"))
    of = lambda n: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *[F.col(f"x.t{k}") for k in range(n)]).alias("ngram"), F.col(f"x.t{n}").alias("next_token"))
    rows = places.select(*(keep or []), F.explode(F.array(*[of(n) for n in range(n_min, n_max + 1)])).alias("g"))
    return rows.filter("g.next_token is not null").select(*(keep or []), "g.*")


def counts(d: DataFrame, tokens: str, n_max: int = 4, n_min: int = 1) -> DataFrame:
    """(n, ngram, next_token, cnt) of all n-grams."""
    return counts_of_all([d], tokens, n_max, n_min)


def counts_of_all(tables: list[DataFrame], tokens: str, n_max: int = 4, n_min: int = 1, asked: DataFrame | None = None, best: bool = False) -> DataFrame:
    """(n, ngram, next_token, cnt): the counts of several tables, added up.

    A place is one row, the window of its token and the n_max tokens behind it, whatever the number of orders. Windows meet by their first n_min + 1
    tokens, which all of their n-grams begin with, and are sorted there; the n-grams are then runs of equal beginnings. Tokens aren't empty and hold no blank or NUL.

    With ``asked`` (n, ngram), all n-grams are counted as before and meet those asked where they are counted: of more than n_min tokens, only the
    asked ones' counts leave the task; n-grams of n_min tokens lie in several tasks and leave whole.

    With ``best``, of an n-gram's next tokens only the most frequent of each task and batch leave (the smaller token on ties), each with its whole count;
    ``best_next`` finds the best of these, but the sum of all counts is lost.
    """
    t, u = F.col(tokens), None
    for d in tables:
        shifted = F.arrays_zip(*[(t if k == 0 else F.slice(t, k + 1, F.greatest(F.size(t) - k, F.lit(0)))).alias(f"t{k}") for k in range(n_max + 1)])
        x = d.filter(F.size(t) > n_min).select(F.explode(shifted).alias("x")).filter(f"x.t{n_min} is not null")
        x = x.select(F.concat_ws(GAP, *[F.col(f"x.t{k}") for k in range(n_max + 1)]).alias("w"))
        u = x if u is None else u.unionByName(x)
    if asked is not None:
        # an n-gram with an empty token behind it: sorts right before the windows that begin with it and go on
        u = u.unionByName(asked.select(F.concat(F.replace("ngram", F.lit(" "), F.lit(GAP)), F.lit(GAP)).alias("w")))
    u = u.repartition(F.substring_index("w", GAP, n_min + 1)).sortWithinPartitions("w")
    return u.mapInArrow(_runs(n_max, n_min, asked is not None, best), "n int, ngram string, next_token string, cnt long")


def _runs(n_max: int, n_min: int, some: bool = False, best: bool = False):
    """Runs of equal beginnings of sorted windows; the last run of each order waits for the next batch.

    With ``some``, the runs of more than n_min tokens leave only if an asked n-gram (a window that ends in an empty token) stands before them.
    """

    def batch(n: int, grams: pa.Array, nexts: pa.Array, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), grams, nexts, pa.array(c)], ["n", "ngram", "next_token", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        wanted: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            parts = pc.split_pattern(b.column("w"), GAP)
            offsets = parts.offsets.to_numpy()
            size, flat = np.diff(offsets), parts.values
            first, change, columns = offsets[:-1], np.zeros(b.num_rows, bool), []
            change[0] = True
            mark = pc.ends_with(b.column("w"), GAP).to_numpy(zero_copy_only=False) if some else np.zeros(b.num_rows, bool)
            for k in range(n_max + 1):
                there = size > k
                c = flat.take(pa.array(np.where(there, first + k, 0), mask=~there))
                gram = np.cumsum(change) - 1  # the k-grams of the batch by number
                chosen = None
                if some and k > n_min:
                    # which of them are asked; the first may go on from the batch before
                    chosen = np.zeros(gram[-1] + 1, bool)
                    chosen[gram[mark & (size == k + 1)]] = True
                    chosen[0] |= k in wanted and wanted[k] == [x[0].as_py() for x in columns]
                    wanted.pop(k, None)
                    if chosen[-1]:
                        wanted[k] = [x[-1].as_py() for x in columns]
                    chosen = chosen[gram]
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                change[1:] |= ~(same | ~(there[1:] | there[:-1]))
                columns.append(c)
                if k < max(n_min, 1):
                    continue
                rows = np.flatnonzero(there & ~mark)
                if not len(rows):
                    continue
                # a mark between two windows of one run changes nothing: runs are told apart by the changes up to their first window
                number = np.cumsum(change)[rows]
                starts = np.flatnonzero(np.diff(number, prepend=0))
                n = np.diff(np.append(starts, len(rows))).astype(np.int64)
                if chosen is not None:
                    left = chosen[rows[starts]]
                    starts, n = starts[left], n[left]
                    if not len(starts):
                        continue
                at = rows[starts]
                ends = [(" ".join(x[int(i)].as_py() for x in columns[:k]), c[int(i)].as_py()) for i in (at[0], at[-1])]
                if k in held:
                    *before, more = held[k]
                    if tuple(before) == ends[0]:
                        n[0] += more
                    else:
                        yield batch(k, pa.array(before[:1]), pa.array(before[1:]), np.array([more]))
                held[k] = (*ends[1], int(n[-1]))
                at, n = at[:-1], n[:-1]
                if best and len(n):
                    of = gram[at]
                    groups = np.flatnonzero(np.diff(of, prepend=-1))
                    top = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, groups), np.diff(np.append(groups, len(n)))))
                    top = top[np.flatnonzero(np.diff(of[top], prepend=-1))]
                    at, n = at[top], n[top]
                if len(n):
                    i = pa.array(at)
                    yield batch(k, pc.binary_join_element_wise(*[x.take(i) for x in columns[:k]], " "), c.take(i), n)
        for k, (gram, after, more) in held.items():
            yield batch(k, pa.array([gram]), pa.array([after]), np.array([more]))

    return run


def asked_counts(d: DataFrame, tokens: str, asked: DataFrame, n_max: int, best: bool = False) -> DataFrame:
    """(n, ngram, next_token, cnt) of the n-grams that ``asked`` (n, ngram) holds, and of all single tokens; every n-gram of the texts is counted. ``best`` as for ``counts_of_all``."""
    return counts_of_all([d], tokens, n_max, asked=asked, best=best)


def merge(*tables: DataFrame) -> DataFrame:
    """Adds the counts of several tables."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    return u.groupBy("n", "ngram", "next_token").agg(F.sum("cnt").alias("cnt"))


def best_next(table: DataFrame, min_count: int = 1, min_percent: int = 0) -> DataFrame:
    """(n, ngram, next_token, cnt): the most frequent next token, if it has the count and the share; the smaller token on ties."""
    best = table.groupBy("n", "ngram").agg(F.min(F.struct((-F.col("cnt")).alias("less"), "next_token")).alias("x"), F.sum("cnt").alias("x_t"))
    best = best.select("n", "ngram", "x.next_token", (-F.col("x.less")).alias("cnt"), "x_t")
    return best.filter((F.col("cnt") >= min_count) & (100 * F.col("cnt") >= min_percent * F.col("x_t"))).drop("x_t")


def suffixes(contexts: DataFrame, key: str, tokens: str, n_max: int = 4) -> DataFrame:
    """(key, n, ngram): the last n tokens of each context, dealt by what they are looked up by."""
    t = F.col(tokens)
    sfx = F.array(*[F.when(F.size(t) >= n, F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, F.size(t) - n + 1, n), " ").alias("ngram"))) for n in range(1, n_max + 1)])
    c = contexts.select(key, F.explode(F.filter(sfx, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
    return c.filter("n is not null and ngram is not null").repartition("n", "ngram")


def asked_by(c: DataFrame, key: str) -> DataFrame:
    """(n, ngram): what the suffixes c ask, each once. The count of keys only keeps them in the shuffle, so that Spark reads that again and not the texts."""
    return c.groupBy("n", "ngram").agg(F.count(key).alias("x_c")).filter("x_c >= 0").select("n", "ngram")


def draft(contexts: DataFrame, key: str, tokens: str, tables: list[DataFrame], n_max: int = 4) -> DataFrame:
    """(key, n, ngram, next_token, source): a draft token by the longest known suffix; earlier tables first."""
    c = suffixes(contexts, key, tokens, n_max)
    asked = asked_by(c, key)
    hits = None
    for i, table in enumerate(tables):
        # the semi join goes below the counting, which then counts only what is asked
        h = c.join(best_next(table.join(asked, ["n", "ngram"], "left_semi")), ["n", "ngram"]).withColumn("source", F.lit(i))
        hits = h if hits is None else hits.unionByName(h)
    w = Window.partitionBy(key).orderBy("source", F.desc("n"))
    return hits.withColumn("x_r", F.row_number().over(w)).filter("x_r = 1").select(key, "n", "ngram", "next_token", "source")


def acceptance(d: DataFrame, key: str, tokens: str, n: int = 2, n_draft: int = 4) -> DataFrame:
    """(key, n_drafted, n_accepted): replays a sequence against a table grown from its own past, which is sequential."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key].tolist(), pdf[tokens].tolist(), strict=True):
                seen, i, drafted, accepted = {}, n, 0, 0
                t = list(t) if t is not None else []
                while i < len(t):
                    ctx, guess = t[max(0, i - n) : i], []
                    while len(guess) < n_draft and (g := seen.get(tuple(ctx[-n:]))) is not None:
                        guess.append(g)
                        ctx = [*ctx, g]
                    ok = 0
                    while ok < len(guess) and i + ok < len(t) and guess[ok] == t[i + ok]:
                        ok += 1
                    drafted, accepted = drafted + len(guess), accepted + ok
                    for j in range(i, min(i + ok + 1, len(t))):
                        seen[tuple(t[j - n : j])] = t[j]
                    i += ok + 1
                out.append((k, drafted, accepted))
            yield pd.DataFrame(out, columns=[key, "n_drafted", "n_accepted"])

    kind = dict(d.dtypes)[key]
    return d.select(key, tokens).mapInPandas(run, f"{key} {kind}, n_drafted long, n_accepted long")


def words(text: Column) -> Column:
    """Word pre-tokens: runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"(\w+)"), F.lit(1))
