"""Linear recurrences along sequences by a two-level scan, so that no task holds a sequence.

A state S of a recurrence passes a row by an affine map, S -> S A + B (A a matrix, a row's decay, or a factor for each element), and maps compose
associatively. Rows are sorted into ranges over the whole table. Level one goes through each range once with an empty state: it gives every row
its output so far, the coefficients by which a state from before the range would add to it, and the range's composed map for each sequence.
The maps of a sequence's ranges (at most one for each task) are chained, and level two adds the state that enters each range.

Rows: (seq, pos, inputs as arrays). Rows of one position go in the order of their inputs. A row with a null input leaves the state alone and has
a null out; null seqs are a sequence of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import sorted_runs

Maps = tuple[np.ndarray, np.ndarray]


class Recurrence:
    """One kind of recurrence: ``enter`` gives a row's map, ``read`` its output from a state, ``lean`` the coefficients of an entering state.

    ``A`` and its products are kept as the kind needs them; ``chain(A1, B1, A2, B2)`` composes, ``past(coefficients, S)`` is what an entering
    state adds to an output.
    """

    columns: list[str] = []

    def start(self, row: list[np.ndarray]) -> Maps:
        raise NotImplementedError

    def step(self, a: np.ndarray, s: np.ndarray, row: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, s, out, coefficients) behind ``row``; ``a`` is the composed map and ``s`` the state of the range so far."""
        raise NotImplementedError

    def chain(self, a: np.ndarray, s: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The state behind a range (a, s) that ``before`` enters."""
        raise NotImplementedError

    def past(self, lean: np.ndarray, before: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Decayed(Recurrence):
    """S = diag(g) S + k v; out = q (u k v + S_before) (wkv6) or scale q S_after (gated linear attention). S is keys x values."""

    def __init__(self, columns: list[str], first: np.ndarray | None, scale: float):
        self.columns, self.first, self.scale = columns, first, scale

    def start(self, row):
        q, k, v, g = row
        return np.ones(len(k)), np.zeros((len(k), len(v)))

    def step(self, a, s, row):
        q, k, v, g = row
        kv = np.outer(k, v)
        if self.first is not None:  # the state before the row, with the row's own pair weighted by ``first``
            out, lean = q @ (self.first[:, None] * kv + s), q * a
        s, a = s * g[:, None] + kv, a * g
        if self.first is None:
            out, lean = self.scale * (q @ s), self.scale * q * a
        return a, s, out, lean

    def chain(self, a, s, before):
        return before * a[:, None] + s

    def past(self, lean, before):
        return lean @ before


class Rotated(Recurrence):
    """S = S (diag(w) + a b) + v k; out = S r. S is values x keys, the composed map a matrix of keys."""

    columns = ["r", "w", "k", "v", "a", "b"]

    def start(self, row):
        _, _, k, v, _, _ = row
        return np.eye(len(k)), np.zeros((len(v), len(k)))

    def step(self, m, s, row):
        r, w, k, v, a, b = row
        s = s * w[None, :] + np.outer(s @ a, b) + np.outer(v, k)
        m = m * w[None, :] + np.outer(m @ a, b)
        return m, s, s @ r, m @ r

    def chain(self, m, s, before):
        return before @ m + s

    def past(self, lean, before):
        return before @ lean


class Selective(Recurrence):
    """S = S exp(softplus(dt) decay) + (x softplus(dt)) b; out = S c. S is channels x states, the composed map a factor for each element."""

    columns = ["x", "dt", "b", "c"]

    def __init__(self, decay: list[float]):
        self.decay = np.asarray(decay, dtype=np.float64)

    def start(self, row):
        shape = (len(row[0]), len(self.decay))
        return np.ones(shape), np.zeros(shape)

    def step(self, a, s, row):
        x, dt, b, c = row
        soft = np.where(dt <= 20, np.log1p(np.exp(np.minimum(dt, 20))), dt)
        f = np.exp(soft[:, None] * self.decay[None, :])
        s, a = s * f + b[None, :] * (x * soft)[:, None], a * f
        return a, s, s @ c, a * c[None, :]

    def chain(self, a, s, before):
        return before * a + s

    def past(self, lean, before):
        return (lean.reshape(before.shape) * before).sum(1)


def _flat(x: np.ndarray) -> list[float]:
    return np.asarray(x, dtype=np.float64).reshape(-1).tolist()


def scan(d: DataFrame, kind: Recurrence, tasks: int | None = None) -> DataFrame:
    """(seq, pos, out) of a recurrence over (seq, pos, inputs)."""
    kinds = dict(d.dtypes)
    spark = d.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inputs = [F.col(c).cast("array<double>").alias(c) for c in kind.columns]
    order = ["seq", "pos", "x_h"]
    rows = d.select("seq", "pos", *inputs).withColumn("x_h", F.xxhash64(*kind.columns))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq_type, pos_type = None, None

        def emit(key, part, rows):
            pos, outs, leans, a, s, shape = rows
            n = len(pos)
            columns = [pa.array([key] * n, seq_type), pa.array(pos, pos_type), pa.array([part] * n, pa.int32()), pa.array(outs, pa.list_(pa.float64())), pa.array(leans, pa.list_(pa.float64()))]
            columns += [pa.array([x if i == n - 1 else None for i in range(n)], t) for x, t in ((a, pa.list_(pa.float64())), (s, pa.list_(pa.float64())), (shape, pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays(columns, ["seq", "pos", "part", "out", "lean", "a", "s", "shape"])

        state: Maps | None = None
        held: tuple | None = None
        last = object()
        for b in batches:
            seq_type, pos_type = b.schema.field("seq").type, b.schema.field("pos").type
            for key, t in sorted_runs(iter([b]), ["seq"]):
                if key != last:
                    if held is not None:
                        yield emit(*held)
                    held, state, last = None, None, key
                if held is not None:  # the sequence goes on: what is held isn't its range's end
                    yield emit(held[0], held[1], (*held[2][:3], None, None, None))
                pos, outs, leans, part = t.column("pos").to_pylist(), [], [], t.column("part")[0].as_py()
                values = [t.column(c) for c in kind.columns]
                lists = [[None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in c] for c in values]
                for row in zip(*lists, strict=True):
                    if any(x is None for x in row):
                        outs.append(None), leans.append(None)
                        continue
                    if state is None:
                        state = kind.start(row)
                    a, s, out, lean = kind.step(*state, row)
                    state = (a, s)
                    outs.append(_flat(out)), leans.append(_flat(lean))
                made = (None, None, None) if state is None else (_flat(state[0]), _flat(state[1]), [*state[0].shape, *state[1].shape])
                held = (key[0], part, (pos, outs, leans, *made))
        if held is not None:
            yield emit(*held)

    schema = f"seq {kinds['seq']}, pos {kinds['pos']}, part int, out array<double>, lean array<double>, a array<double>, s array<double>, shape array<int>"
    ranges = materialise(rows.mapInArrow(local, schema), "scan-ranges")

    def enter(t: pa.Table) -> pa.Table:
        """The state that enters each range of a sequence but the first."""
        t = t.sort_by("part")
        parts, states, shape, before = [], [], t.column("shape")[0].as_py(), None
        for part, a, s in zip(t.column("part").to_pylist(), t.column("a"), t.column("s"), strict=True):
            if before is not None:
                parts.append(part)
                states.append(_flat(before))
            a, s = (x.values.to_numpy().reshape(d) for x, d in ((a, shape[:-2]), (s, shape[-2:])))
            before = s if before is None else kind.chain(a, s, before)
        n = len(parts)
        columns = [t.column("seq").combine_chunks().slice(0, n), pa.array(parts, pa.int32()), pa.array(states, pa.list_(pa.float64())), pa.array([shape[-2:]] * n, pa.list_(pa.int32()))]
        return pa.table(columns, ["e_seq", "e_part", "before", "e_shape"])

    ends = ranges.filter("a is not null").select("seq", "part", "a", "s", "shape")
    entering = ends.groupBy("seq").applyInArrow(enter, f"e_seq {kinds['seq']}, e_part int, before array<double>, e_shape array<int>")
    entering = materialise(entering, "scan-entering")
    both = ranges.select("seq", "pos", "part", "out", "lean").join(
        F.broadcast(entering) if entering.count() <= 10_000 else entering, F.col("seq").eqNullSafe(F.col("e_seq")) & (F.col("part") == F.col("e_part")), "left")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outs = []
            for out, lean, before, shape in zip(*(b.column(c) for c in ("out", "lean", "before", "shape")), strict=True):
                y = out.values.to_numpy(zero_copy_only=False) if out.is_valid else None
                if y is not None and before.is_valid:
                    y = y + kind.past(lean.values.to_numpy(zero_copy_only=False), before.values.to_numpy(zero_copy_only=False).reshape(shape.as_py()))
                outs.append(y)
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("pos"), pa.array(outs, pa.list_(pa.float64()))], ["seq", "pos", "out"])

    out = both.select("seq", "pos", "out", "lean", "before", F.col("e_shape").alias("shape"))
    return out.mapInArrow(add, f"seq {kinds['seq']}, pos {kinds['pos']}, out array<double>")
