"""Block-partitioned algebra: matrices as tiles, attention as pairs of blocks, both multiplied in numpy inside tasks.

A matrix of rows (i, j, v) becomes tiles of at most ``TILE`` x ``TILE`` values with a bit for each element that is there. A product replicates
tiles, not elements: each tile of one side goes to every block column of the other, pairs meet by their three block numbers, and a pair's
product is summed with those of its task before its elements are summed in Spark. So the shuffle grows with the number of blocks, and no
task holds more than two tiles and the sums of a few.

Attention cuts positions into blocks. A pair of a query block and a key block gives a partial state for each query: the largest score, the
sum of weights, and the weighted sum of values, all relative to that score. States merge associatively, a bounded number of
blocks at a time, so neither a window nor a whole sequence is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

TILE = 256
#: Tiles up to which a side of a product is broadcast (half a megabyte each at most).
FEW_TILES = 64


def _borders(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Rows at which a run of equal keys starts; nulls are equal to one another."""
    n = batch.num_rows
    fresh = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(0, n - 1), c.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        fresh |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(fresh) + 1).tolist()] if n else []


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal keys in batches that come sorted by them, across batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        edges = [*_borders(b, keys), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = b.slice(lo, hi - lo)
            key = tuple(part.column(k)[0].as_py() for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def by_runs(d: DataFrame, keys: list[str]) -> DataFrame:
    """``d`` dealt out and sorted by ``keys``, as ``sorted_runs`` wants it."""
    return d.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)


_TILE_SCHEMA = "h int, w int, x binary, there binary"


def tiles(m: DataFrame, rows: str, cols: str, by: list[str], size: int = TILE) -> DataFrame:
    """(by, br, bc, h, w, x, there): tiles of elements (by, rows, cols, v); equal places add up, null values are absent."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    kinds = dict(m.dtypes)
    e = m.filter(F.col("v").isNotNull()).select(*by, at(rows).alias("br"), at(cols).alias("bc"), F.pmod(F.col(rows), F.lit(size)).cast("int").alias("r"), F.pmod(F.col(cols), F.lit(size)).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    keys = [*by, "br", "bc"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in sorted_runs(batches, keys):
            r, c, v = (t.column(n).to_numpy() for n in ("r", "c", "v"))
            h, w = int(r.max()) + 1, int(c.max()) + 1
            x, there = np.zeros((h, w)), np.zeros((h, w), dtype=bool)
            np.add.at(x, (r, c), v)
            there[r, c] = True
            columns = [t.column(k).slice(0, 1).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([np.packbits(there).tobytes()], pa.binary())], [*keys, "h", "w", "x", "there"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "br long", "bc long", _TILE_SCHEMA])
    return by_runs(e, keys).mapInArrow(pack, schema)


def _matrix(h: int, w: int, x: bytes, there: bytes) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.frombuffer(there, dtype=np.uint8), count=h * w).reshape(h, w).astype(bool)
    return np.frombuffer(x).reshape(h, w), bits


def pair_product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """a (n x k) times the transpose of b (m x k) over the places that both have, and which places of the product have any."""
    k = min(a[0].shape[1], b[0].shape[1])
    (x, p), (y, q) = ((m[:, :k], t[:, :k]) for m, t in (a, b))
    meets = (p.astype(np.float32) @ q.astype(np.float32).T) > 0
    if np.isfinite(x).all() and np.isfinite(y).all():
        return x @ y.T, meets
    # An absent element is no zero here: it would turn an infinite one into NaN.
    out = np.zeros((len(x), len(y)))
    for c in range(k):
        out[np.ix_(p[:, c], q[:, c])] += np.outer(x[p[:, c], c], y[q[:, c], c])
    return out, meets


def product(a: DataFrame, b: DataFrame, over: str, left: str, right: str, by: list[str] | None = None, size: int = TILE) -> DataFrame:
    """(by, left, right, v): sums over ``over`` of a(by, left, over, v) times b(by, right, over, v).

    A place of the result is there if some ``over`` is in both its rows. Equal places of an input add up; null values, and nulls in an index, take no
    part; nulls in ``by`` meet nothing. An empty side gives an empty result; other columns are ignored.
    """
    by = by or []
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    whole = lambda m, i: m.select(*by, i, over, "v").dropna(subset=[*by, i, over])
    ta = materialise(tiles(whole(a, left), left, over, by, size), "tiles")
    tb = materialise(tiles(whole(b, right), right, over, by, size), "tiles")
    span = lambda t: t.agg(F.min("br"), F.max("br"), F.count("*")).collect()[0]
    (a_lo, a_hi, a_n), (b_lo, b_hi, b_n) = span(ta), span(tb)
    named = lambda t, s: t.select(*by, F.col("br").alias(f"{s}_br"), "bc", *[F.col(c).alias(f"{s}_{c}") for c in ("h", "w", "x", "there")])
    x, y = named(ta, "a"), named(tb, "b")
    if min(a_n, b_n) <= FEW_TILES:
        pairs = x.join(F.broadcast(y) if b_n <= a_n else y, [*by, "bc"]) if b_n <= a_n else F.broadcast(x).join(y, [*by, "bc"])
    else:
        x = x.withColumn("b_br", F.explode(F.sequence(F.lit(b_lo), F.lit(b_hi))))
        y = y.withColumn("a_br", F.explode(F.sequence(F.lit(a_lo), F.lit(a_hi))))
        pairs = x.join(y, [*by, "a_br", "bc", "b_br"])
    keys = [*by, "a_br", "b_br"]
    schema = ", ".join([*(f"{c} {kinds_a[c]}" for c in by), f"{left} long", f"{right} long", "v double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for key, (total, there, columns) in held.items():
                i, j = np.nonzero(there)
                n = len(i)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(n, dtype=np.int32))) for c in columns), pa.array(i + key[-2] * size), pa.array(j + key[-1] * size), pa.array(total[i, j])], [*by, left, right, "v"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                got = {c: batch.column(c)[r].as_py() for c in batch.schema.names if c not in by}
                columns = [batch.column(c).slice(r, 1) for c in by]
                key = (*(c[0].as_py() for c in columns), got["a_br"], got["b_br"])
                v, there = pair_product(_matrix(*(got[f"a_{c}"] for c in ("h", "w", "x", "there"))), _matrix(*(got[f"b_{c}"] for c in ("h", "w", "x", "there"))))
                if key in held and held[key][0].shape == v.shape:
                    held[key][0] += v
                    held[key][1] |= there
                else:
                    if key in held or len(held) >= 32:
                        yield from emit()
                    held[key] = [v, there, columns]
        yield from emit()

    out = pairs.select(*keys, "bc", *[f"{s}_{c}" for s in "ab" for c in ("h", "w", "x", "there")]).mapInArrow(run, schema)
    return out.groupBy(*by, F.col(left).cast(kinds_a[left]).alias(left), F.col(right).cast(kinds_b[right]).alias(right)).agg(F.sum("v").alias("v"))


# Attention


def block_scores(q: np.ndarray, k: np.ndarray, scale: float, softcap: float, add: np.ndarray, seen: np.ndarray) -> np.ndarray:
    s = (q @ k.T) * scale
    if softcap:
        s = softcap * np.tanh(s / softcap)
    return np.where(seen, s + add[None, :], -np.inf)


def merge_states(states: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One state of several for the same queries: (largest score, sum of weights, weighted values), in any order and grouping."""
    top = np.max([m for m, _, _ in states], axis=0)
    base = np.where(np.isfinite(top), top, 0.0)
    total, out = np.zeros_like(top), np.zeros_like(states[0][2])
    for m, s, o in states:
        w = np.exp(m - base)
        total += s * w
        out += o * w[:, None]
    return top, total, out


def _rows(c: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = c.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, -1)


_STATE = "pos array<long>, top array<double>, total array<double>, out array<double>"


def _state_batch(keys: dict[str, pa.Array], pos: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.reshape(-1), t))
    columns = [one(pos, pa.int64()), *(one(x, pa.float64()) for x in state)]
    return pa.RecordBatch.from_arrays([*keys.values(), *columns], [*keys, "pos", "top", "total", "out"])


def attend(d: DataFrame, window: int | None, scale: float, softcap: float = 0.0, mask: str | None = None, block: int = 1024, fan: int = 16) -> DataFrame:
    """(seq, pos, out): softmax attention of (seq, pos, q, k, v) over the positions from pos - window + 1 (all, if None) to pos.

    ``mask`` is a column of the key's row that is added to its scores; where it is null the key is out. Rows whose q, k or v is null, or
    whose pos is, take no part. A query that sees no key has a null out. Rows of one position see one another. Repeated rows have a row of the
    result each, an empty table none. ``block``: positions in a block. ``fan``: states merged at a time.
    """
    kinds = dict(d.dtypes)
    add = F.lit(0.0) if mask is None else F.col(mask).cast("double")
    doubles = [F.col(c).cast("array<double>").alias(c) for c in "qkv"]
    rows = d.select("seq", F.col("pos").cast("long").alias("pos"), *doubles, add.alias("add")).dropna(subset=["pos", "q", "k", "v"])
    rows = materialise(rows.withColumn("at", F.floor(F.col("pos") / block)), "attention-rows")
    blocks = rows.groupBy("seq", "at").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    mine, other = (blocks.select(F.col("seq").alias(f"{s}_seq"), *[F.col(c).alias(f"{s}_{c}") for c in ("at", "low", "high")]) for s in "qk")
    meet = F.col("q_seq").eqNullSafe(F.col("k_seq")) & (F.col("k_at") <= F.col("q_at"))
    meet = meet if window is None else meet & (F.col("k_high") > F.col("q_low") - window)
    pairs = materialise(mine.join(other, meet).select(F.col("q_seq").alias("p_seq"), "q_at", "k_at"), "attention-pairs")
    on = lambda at: F.col("seq").eqNullSafe(F.col("p_seq")) & (F.col("at") == F.col(at))
    queries = rows.join(pairs, on("q_at")).select("seq", "q_at", "k_at", "pos", F.lit(True).alias("asks"), F.col("q").alias("x"), F.lit(None).cast("array<double>").alias("v"), "add")
    keys = rows.filter("add is not null").join(pairs, on("k_at")).select("seq", "q_at", "k_at", "pos", F.lit(False).alias("asks"), F.col("k").alias("x"), "v", "add")
    unit = ["seq", "q_at", "k_at"]

    def partial(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks, known = t.filter(t.column("asks")), t.filter(pc.invert(t.column("asks")))
        n, m = len(asks), len(known)
        if not n:
            return
        q, pos = _rows(asks.column("x"), n), asks.column("pos").to_numpy()
        order = np.lexsort((*q.T[::-1], pos))
        q, pos = q[order], pos[order]
        names = {c: asks.column(c).slice(0, 1).combine_chunks() for c in unit}
        if not m:
            yield _state_batch(names, pos, (np.full(n, -np.inf), np.zeros(n), np.zeros((n, 1))))
            return
        k, v, at, plus = _rows(known.column("x"), m), _rows(known.column("v"), m), known.column("pos").to_numpy(), known.column("add").to_numpy()
        order = np.argsort(at, kind="stable")
        k, v, at, plus = k[order], v[order], at[order], plus[order]
        tops, totals, outs = [], [], []
        for lo in range(0, n, 256):
            p = pos[lo : lo + 256]
            first = 0 if window is None else int(np.searchsorted(at, p[0] - window + 1, "left"))
            last = int(np.searchsorted(at, p[-1], "right"))
            seen = at[None, first:last] <= p[:, None]
            if window is not None:
                seen &= at[None, first:last] > p[:, None] - window
            if last <= first:
                tops.append(np.full(len(p), -np.inf)), totals.append(np.zeros(len(p))), outs.append(np.zeros((len(p), v.shape[1])))
                continue
            s = block_scores(q[lo : lo + 256], k[first:last], scale, softcap, plus[first:last], seen)
            top = s.max(axis=1)
            w = np.exp(s - np.where(np.isfinite(top), top, 0.0)[:, None])
            tops.append(top), totals.append(w.sum(axis=1)), outs.append(w @ v[first:last])
        yield _state_batch(names, pos, (np.concatenate(tops), np.concatenate(totals), np.concatenate(outs)))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in sorted_runs(batches, unit):
            yield from partial(key, t)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in sorted_runs(batches, unit):
            pos, states = t.column("pos")[0].values.to_numpy(), []
            for i in range(len(t)):
                top, total, out = (t.column(c)[i].values.to_numpy() for c in ("top", "total", "out"))
                states.append((top, total, out.reshape(len(pos), -1)))
            width = max(o.shape[1] for _, _, o in states)
            states = [(m, s, o if o.shape[1] == width else np.zeros((len(pos), width))) for m, s, o in states]
            yield _state_batch({c: t.column(c).slice(0, 1).combine_chunks() for c in unit}, pos, merge_states(states))

    schema = f"seq {kinds['seq']}, q_at long, k_at long, {_STATE}"
    states = by_runs(queries.unionByName(keys), unit).mapInArrow(partials, schema)
    # Neighbouring key blocks merge ``fan`` at a time, until every query block has one state.
    places = pairs.agg(F.min("k_at").alias("low"), F.max("k_at").alias("high")).collect()[0]
    low, left = places["low"] or 0, (places["high"] or 0) - (places["low"] or 0)
    while left or low:
        states = by_runs(states.withColumn("k_at", F.floor((F.col("k_at") - low) / fan)), unit).mapInArrow(merged, schema)
        low, left = 0, left // fan

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pos, total, out = (b.column(c)[i].values.to_numpy() for c in ("pos", "total", "out"))
                n, some = len(pos), total > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    x = out.reshape(n, -1) / total[:, None]
                ends = np.arange(n + 1, dtype=np.int32) * x.shape[1]
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)), mask=pa.array(~some))
                yield pa.RecordBatch.from_arrays([b.column("seq").slice(i, 1).take(pa.array(np.zeros(n, dtype=np.int32))), pa.array(pos), rows], ["seq", "pos", "out"])

    out = states.mapInArrow(spread, f"seq {kinds['seq']}, pos long, out array<double>")
    return out.withColumn("pos", F.col("pos").cast(kinds["pos"]))
