"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (``sample`` rows or 32 for each part, by hash of the id) gives a neighbour graph, which is cut into balanced
parts: halved again and again along its leading directions, then refined by moving nodes to the part of most of their neighbours as far as
the parts' capacity allows. A classifier with one hidden layer learns the parts of a node and its neighbours from the vector.
It assigns every vector of the table to its most probable part, and routes a query to its most probable parts, as many as gave
``target`` recall on sample queries. There the query meets all vectors of the part, and what it finds is scored anew
in double precision, one dimension after the other.

The parts follow the table: one for ``rows_per_part`` vectors, but ``least_parts`` (as far as 16 vectors are there for each) and
``most_parts`` at most, rounded down to a power of two. So small tables are routed too.

Parts are split into blocks of rows and of queries, so that a task holds one block of each. Equal vectors are one entry with the ids
that can be among the nearest (the ``k`` + 1 smallest): all others of them rank behind.

Vectors that are null, empty, all zero or hold a null, NaN or infinite component take no part, nor do those without an id or with another
length than most. Of rows that repeat an id the smallest vector counts. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product for each row, itself left out."""
    out, x = [], x.astype(np.float32)
    for lo in range(0, len(x), 256):
        s = x[lo : lo + 256] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def neighbours_of(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """As neighbours, for some rows alone."""
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    return np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 6, slack: float = 1.05) -> np.ndarray:
    """Part of each node: recursive halving, then moves along the graph within the parts' capacity."""
    of = np.zeros(len(x), dtype=np.int64)
    for _ in range(parts.bit_length() - 1):
        nxt = of * 2
        for p in range(of.max() + 1):
            at = np.flatnonzero(of == p)
            y = x[at] - x[at].mean(0)
            v = np.linalg.eigh(y.T @ y)[1][:, -1]
            nxt[at[np.argsort(y @ v, kind="stable")[len(at) // 2 :]]] += 1
        of = nxt
    most = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(of, minlength=parts)
    both = [list(g) for g in graph]
    for i, g in enumerate(graph):
        for j in g:
            both[j].append(i)
    for _ in range(passes):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(of[both[i]], minlength=parts)
            votes = np.where(size < most, votes, -1)
            votes[of[i]] = (of[both[i]] == of[i]).sum()
            to = int(votes.argmax())
            if votes[to] > votes[of[i]]:
                size[of[i]] -= 1
                size[to] += 1
                of[i] = to
                moved += 1
        if moved < len(x) // 200:
            break
    return of


class Router:
    """One hidden layer, softmax over the parts; trained by Adam on soft targets."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), r.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, t: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> Router:
        r, m, v, step = np.random.default_rng(seed), [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - t[at]) / len(at)
                dh = (d @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :probes]


def learn(x: np.ndarray, parts: int, k: int, target: float, graph_k: int = 10) -> tuple[Router, int]:
    """(router, probes): fitted on the sample; probes by the recall of up to 400 of its rows as queries."""
    while parts > 1 and len(x) < 4 * parts:
        parts //= 2
    if parts == 1:
        return Router(x.shape[1], 1), 1
    graph = neighbours(x, graph_k)
    of = balanced_parts(x, graph, parts)
    soft = np.zeros((len(x), parts), dtype=np.float32)
    for g in (np.arange(len(x))[:, None], graph):
        for c in range(g.shape[1]):
            soft[np.arange(len(x)), of[g[:, c]]] += 3.0 if g.shape[1] == 1 else 1.0
    soft /= soft.sum(1, keepdims=True)
    router = Router(x.shape[1], parts).fit(x, soft)
    home = router.best(x, 1)[:, 0]
    q = np.unique(np.linspace(0, len(x) - 1, 400).astype(int))
    near = np.concatenate([neighbours_of(x, q[lo : lo + 100], k) for lo in range(0, len(q), 100)])
    rank = np.argsort(np.argsort(-router.logits(x[q]), axis=1, kind="stable"), axis=1)
    needed = rank[np.arange(len(q))[:, None], home[near]]
    recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    return router, int(np.argmax(recall >= target)) + 1 if (recall >= target).any() else parts


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _found(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest ids of each query among the entries of one block."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        r, all_ids = _stack(rows["v"]), rows["ids"].tolist()
        for lo in range(0, len(queries), 256):
            part = queries.iloc[lo : lo + 256]
            q = _stack(part["v"])
            s = q @ r.T
            if s.shape[1] > k + 1:
                edge = -np.partition(-s, k, axis=1)[:, k]
            else:
                edge = np.full(len(q), -np.inf)
            edge = edge - 1e-9 * (1 + np.abs(edge)) if s.shape[1] > k + 1 else edge
            for i, qid in enumerate(part["query_id"].tolist()):
                at = np.flatnonzero(s[i] >= edge[i])
                exact = np.zeros(len(at))
                for d in range(r.shape[1]):
                    exact += q[i, d] * r[at, d]
                best = sorted((-e, j) for e, a in zip(exact.tolist(), at.tolist(), strict=True) for j in all_ids[a] if j != qid)[:k]
                out["query_id"] += [qid] * len(best)
                out["vec_id"] += [j for _, j in best]
                out["score"] += [-e for e, _ in best]
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def clean(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v: one row per id with a vector that takes part."""
    v = F.col(column).cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    d = vectors.filter(F.coalesce(ok, F.lit(False))).select("vec_id", F.col(column).alias("v"))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    d = d.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return d.groupBy("vec_id").agg(F.min("v").alias("v"))


def parts_for(n: int, rows_per_part: int, least_parts: int, most_parts: int) -> int:
    """Parts for n vectors, a power of two."""
    return 1 << max(1, min(most_parts, max(n // rows_per_part, min(least_parts, n // 16)))).bit_length() - 1


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = 8_000, target: float = 0.97, block: int = 16_384, query_block: int = 4_096, rows_per_part: int = 2_000, least_parts: int = 16, most_parts: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose id is divisible by ``every``."""
    d = store(clean(vectors), "ann-vectors")
    n = d.count()
    parts = parts_for(n, rows_per_part, least_parts, most_parts)
    sample = max(sample, 32 * parts)
    h = F.xxhash64("vec_id", F.lit("ann"))
    ids = F.broadcast(d.select("vec_id", h.alias("h")).orderBy("h", "vec_id").limit(sample).select("vec_id"))
    got = d.join(ids, "vec_id", "left_semi").toPandas().sort_values("vec_id")
    x = _stack(got["v"])
    del got
    router, probes = learn(x, parts, k, target) if len(x) else (Router(1, 1), 1)

    def route(m: int):
        def run(batches):
            for pdf in batches:
                best = router.best(_stack(pdf["v"]), m) if len(pdf) else np.zeros((0, m), dtype=np.int64)
                yield pdf.assign(parts=list(best.astype(np.int32)))

        return run

    kind = dict(d.dtypes)["v"]
    w = Window.partitionBy("v").orderBy("vec_id")
    entries = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = entries.mapInPandas(route(1), f"v {kind}, ids array<long>, parts array<int>").withColumn("part", F.col("parts")[0]).drop("parts")
    entries = store(entries, "ann-index")
    queries = d.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    queries = queries.mapInPandas(route(probes), f"query_id long, v {kind}, parts array<int>").withColumn("part", F.explode("parts")).drop("parts")
    queries = store(queries, "ann-queries")
    rows_in = entries.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("rbs"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qbs"))
    blocks = F.broadcast(store(rows_in.join(asked, "part"), "ann-blocks"))  # at most most_parts rows
    e = entries.join(blocks, "part").withColumn("rb", F.pmod(F.xxhash64(F.col("ids")[0]), "rbs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    q = queries.join(blocks, "part").withColumn("qb", F.pmod(F.xxhash64("query_id"), "qbs").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))
    keys = ["part", "rb", "qb"]
    found = q.select(*keys, "query_id", "v").groupBy(*keys).cogroup(e.select(*keys, "v", "ids").groupBy(*keys)).applyInPandas(lambda a, b: _found(a, b, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
