"""Block algebra, associative scans and distributed selection against numpy, with hot groups, nulls, ties, repeats and empty tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions import blocks, layout, scans, tensor
from notewright.operators import sampling, selection


def coo(spark, x, names=("i", "j"), keep=None):
    keep = np.ones(x.shape, dtype=bool) if keep is None else keep
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(keep), strict=True)], f"{names[0]} int, {names[1]} long, v double")


@pytest.mark.parametrize(("n", "m", "k", "few"), [(7, 5, 9, 64), (30, 23, 41, 0), (1, 1, 1, 0), (33, 2, 70, 0)])
def test_product_of_tiles(spark, monkeypatch, n, m, k, few):
    monkeypatch.setattr(blocks, "FEW_TILES", few)
    r = np.random.default_rng(1)
    a, b = r.normal(size=(n, k)), r.normal(size=(m, k))
    pa, pb = r.random((n, k)) < 0.4, r.random((m, k)) < 0.4
    got = blocks.product(coo(spark, a, ("i", "j"), pa), coo(spark, b, ("x", "j"), pb), "j", "i", "x", size=8).collect()
    meets = pa.astype(int) @ pb.astype(int).T
    assert {(g["i"], g["x"]) for g in got} == set(zip(*(z.tolist() for z in np.nonzero(meets)), strict=True))
    want = np.where(pa, a, 0) @ np.where(pb, b, 0).T
    assert all(abs(g["v"] - want[g["i"], g["x"]]) < 1e-9 for g in got)
    assert dict(blocks.product(coo(spark, a, ("i", "j")), coo(spark, b, ("x", "j")), "j", "i", "x").dtypes) == {"i": "int", "x": "int", "v": "double"}


def test_product_of_odd_elements(spark):
    a = spark.createDataFrame([(-3, 0, 2.0, "g"), (-3, 0, 1.0, "g"), (-3, 700, float("inf"), "g"), (4, 0, None, "g"), (4, None, 1.0, "g"), (9, 0, 1.0, None)], "i long, j long, v double, by string")
    b = spark.createDataFrame([(0, 0, 5.0, "g"), (300, 700, 2.0, "g"), (300, 0, 1.0, "h"), (7, 0, 1.0, None)], "k long, j long, v double, by string")
    got = {(r["by"], r["i"], r["k"]): r["v"] for r in blocks.product(a, b, "j", "i", "k", ["by"]).collect()}
    assert got == {("g", -3, 0): 15.0, ("g", -3, 300): float("inf")}
    assert blocks.product(a.limit(0), b, "j", "i", "k").count() == 0 and blocks.product(a, b.limit(0), "j", "i", "k").count() == 0


def test_routed_product_and_outer_product(spark):
    r = np.random.default_rng(2)
    experts, rows = r.normal(size=(3, 4, 6)), r.normal(size=(5, 6))
    e = spark.createDataFrame([(x, i, j, float(experts[x, i, j])) for x, i, j in itertools.product(range(3), range(4), range(6))], "e int, i int, j int, v double")
    b = spark.createDataFrame([(i, j, float(rows[i, j])) for i, j in itertools.product(range(5), range(6))], "row int, j int, v double")
    ids = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 1), (4, 2), (9, 1)], "row int, e int")
    got = {(x["row"], x["e"], x["i"]): x["v"] for x in tensor.mul_mat_id(e, b, ids).collect()}
    assert set(got) == {(x, y, i) for x, y in ((0, 0), (0, 2), (1, 1), (4, 2)) for i in range(4)}
    assert all(abs(v - experts[y, i] @ rows[x]) < 1e-9 for (x, y, i), v in got.items())
    a = b.select(F.lit("img").alias("by"), F.col("row").alias("r"), F.col("j").alias("i"), "v")
    out = {(x["i"], x["k"]): x["v"] for x in layout.out_prod(a, a.withColumnRenamed("i", "k"), ["by"]).collect()}
    assert all(abs(out[i, j] - (rows.T @ rows)[i, j]) < 1e-9 for i, j in itertools.product(range(6), range(6)))


# Attention


def plain_attention(rows, window, scale, softcap=0.0):
    out = []
    for s, p, q, _, _, _ in rows:
        seen = [(k, v, m) for s2, p2, _, k, v, m in rows if s2 == s and p2 <= p and (window is None or p2 > p - window) and m is not None]
        if not seen:
            out.append((s, p, None))
            continue
        x = np.array([np.dot(q, k) * scale for k, _, _ in seen])
        x = (softcap * np.tanh(x / softcap) if softcap else x) + np.array([m for _, _, m in seen])
        w = np.exp(x - x.max())
        out.append((s, p, (w / w.sum()) @ np.array([v for _, v, _ in seen])))
    return out


def close(got, want):
    spell = lambda x: (str(x[0]), x[1], None if x[2] is None else tuple(np.round(x[2], 8) + 0.0))
    got, want = (sorted(map(spell, z), key=str) for z in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (g[2] is None or np.allclose(g[2], w[2], atol=1e-6))


@pytest.mark.parametrize(("window", "block", "fan"), [(5, 4, 2), (5, 64, 2), (None, 4, 2), (None, 3, 16), (1, 4, 2), (40, 8, 3)])
def test_attention_by_blocks(spark, window, block, fan):
    r = random.Random(4)
    vec = lambda n: [r.gauss(0, 1) for _ in range(n)]
    rows = [("hot", p, vec(3), vec(3), vec(2), None if p % 5 == 0 else r.choice([0.0, -1.5])) for p in range(60) if p % 7 != 3]
    rows += [("b", p, vec(3), vec(3), vec(2), 0.5) for p in (-9, 0, 400, 401)] + [(None, 1, vec(3), vec(3), vec(2), 0.0)]
    rows += [rows[9], rows[9], ("b", 400, vec(3), vec(3), vec(2), 1.0)]
    lost = [("b", None, vec(3), vec(3), vec(2), 0.0), ("b", 402, None, vec(3), vec(2), 0.0)]
    d = spark.createDataFrame(rows + lost, "seq string, pos int, q array<double>, k array<double>, v array<double>, m double")
    got = blocks.attend(d, window, 0.7, 3.0, "m", block=block, fan=fan).collect()
    close([(x["seq"], x["pos"], x["out"]) for x in got], plain_attention(rows, window, 0.7, 3.0))
    assert blocks.attend(d.limit(0), window, 1.0).count() == 0


def test_attention_of_huge_scores_stays_finite(spark):
    d = spark.createDataFrame([("s", p, [1e3 * (p + 1)], [1e3], [float(p)]) for p in range(30)], "seq string, pos long, q array<double>, k array<double>, v array<double>")
    got = {x["pos"]: x["out"][0] for x in blocks.attend(d, None, 1.0, block=4, fan=2).collect()}
    assert all(abs(got[p] - p / 2) < 1e-9 for p in range(30))


def test_states_merge_in_any_grouping():
    r = np.random.default_rng(0)
    parts = [(r.normal(size=4) * 50, r.random(4) + 0.1, r.normal(size=(4, 3))) for _ in range(7)]
    parts[2] = (np.full(4, -np.inf), np.zeros(4), np.zeros((4, 3)))
    one = blocks.merge_states(parts)
    two = blocks.merge_states([blocks.merge_states(parts[4:]), blocks.merge_states(parts[:4][::-1])])
    assert all(np.allclose(x, y) for x, y in zip(one, two, strict=True))


# Scans


def plain_scan(kind, rows):
    """Row by row with the whole state, by the formulas as they stand."""
    state, out = {}, []
    for s, p, x in rows:
        if any(v is None for v in x):
            out.append((s, p, None))
            continue
        x = [np.array(v) for v in x]
        if kind == "wkv6":
            r, k, v, w = x
            old = state.get(s, np.zeros((len(k), len(v))))
            y = r @ (0.3 * np.outer(k, v) + old)
            state[s] = np.diag(w) @ old + np.outer(k, v)
        elif kind == "gla":
            q, k, v, g = x
            state[s] = np.diag(g) @ state.get(s, np.zeros((len(k), len(v)))) + np.outer(k, v)
            y = 0.5 * (q @ state[s])
        elif kind == "wkv7":
            r, w, k, v, a, b = x
            state[s] = state.get(s, np.zeros((len(v), len(k)))) @ (np.diag(w) + np.outer(a, b)) + np.outer(v, k)
            y = state[s] @ r
        else:
            u, dt, b, c = x
            soft = np.log1p(np.exp(dt))
            state[s] = state.get(s, np.zeros((len(u), len(b)))) * np.exp(np.outer(soft, [-0.5, -1.0, -0.1])) + np.outer(u * soft, b)
            y = state[s] @ c
        out.append((s, p, y))
    return out


KINDS = {
    "wkv6": (["r", "k", "v", "w"], [3, 3, 2, 3], lambda: scans.Decayed(["r", "k", "v", "w"], np.full(3, 0.3), 1.0)),
    "gla": (["q", "k", "v", "g"], [3, 3, 2, 3], lambda: scans.Decayed(["q", "k", "v", "g"], None, 0.5)),
    "wkv7": (["r", "w", "k", "v", "a", "b"], [3, 3, 3, 2, 3, 3], scans.Rotated),
    "ssm": (["x", "dt", "b", "c"], [2, 2, 3, 3], lambda: scans.Selective([-0.5, -1.0, -0.1])),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("tasks", [1, 7])
def test_scans_equal_row_by_row(spark, kind, tasks):
    names, sizes, make = KINDS[kind]
    r = random.Random(6)
    rows = [("hot", p, [[r.uniform(-0.9, 0.9) for _ in range(n)] for n in sizes]) for p in range(150)]
    rows += [("b", p, [[r.uniform(-0.9, 0.9) for _ in range(n)] for n in sizes]) for p in (5, 8)] + [(None, 1, [[0.5] * n for n in sizes])]
    rows += [("late", p, [None if p < 3 else [0.25 * p] * n for n in sizes]) for p in range(6)] + [("none", 1, [None] * len(sizes))]
    rows.insert(40, ("hot", 39, [None, *rows[0][2][1:]]))
    shuffled = r.sample(rows, len(rows))
    d = spark.createDataFrame([(s, p, *x, "extra") for s, p, x in shuffled], "seq string, pos long, " + ", ".join(f"{n} array<double>" for n in names) + ", part string")
    got = scans.scan(d, make(), tasks).collect()
    close([(x["seq"], x["pos"], x["out"]) for x in got], plain_scan(kind, rows))
    assert scans.scan(d.limit(0), make(), tasks).count() == 0


# Selection


GROUPS = {
    "hot": [random.Random(1).expovariate(0.01) for _ in range(4_000)], "ties": [7.0] * 900 + [8.0] * 100, "one": [3.5], "edges": [float("-inf"), -1e308, 0.0, 1e308, float("inf"), float("nan")],
    "tails": [2.0**-i for i in range(0, 900, 30)], None: [1.0, 2.0, 4.0], "signed": [0.0, -0.0, -5e-324, 5e-324, 1.0],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(g, x) for g, xs in GROUPS.items() for x in xs] + [("hot", None), ("empty", None)]
    return spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "g string, x double")


@pytest.mark.parametrize(("bins", "few"), [(64, 8), (1024, 2048)])
def test_percentiles_equal_sorting(values, bins, few):
    points = [0.0, 0.001, 0.05, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: r for r in selection.percentiles(values, ["g"], "x", points, bins, few).collect()}
    assert set(got) == set(GROUPS)
    for g, xs in GROUPS.items():
        xs = sorted(xs, key=lambda v: (v != v, v))
        assert got[g]["n"] == len(xs)
        for p, v in zip(points, got[g]["points"], strict=True):
            at = p * (len(xs) - 1)
            lo, hi = xs[int(np.floor(at))], xs[int(np.ceil(at))]
            want = lo if lo == hi else lo * (1 - at % 1) + hi * (at % 1)
            assert v == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_percentiles_of_nothing(values):
    assert selection.percentiles(values.limit(0), ["g"], "x", [0.5]).count() == 0
    assert [r["points"] for r in selection.percentiles(values.filter("g = 'ties'"), [], "x", [0.5, 0.95]).collect()] == [[7.0, 8.0]]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k_by_buckets(spark, k):
    r = random.Random(9)
    rows = [("hot", i, r.choice([r.gauss(0, 1), 1.25])) for i in range(3_000)] + [("ties", i, 2.0) for i in range(50)] + [("inf", 1, float("inf")), ("inf", 2, 0.0), ("inf", 3, float("-inf")), (None, 1, 0.5), ("few", 1, 1e300), ("few", 2, -1e300), ("few", 3, 0.0)]
    d = spark.createDataFrame(r.sample(rows, len(rows)), "ctx string, id long, logit double")
    want = []
    for c in {x[0] for x in rows}:
        want += sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1]))[:k]
    assert sorted(map(str, ((x["ctx"], x["id"], x["logit"]) for x in sampling.top_k(d, k).collect()))) == sorted(map(str, want))
    kept = selection.at_least_kth(d, "ctx", "logit", 5).filter("ctx = 'hot'").count()
    assert 5 <= kept < 1_000 or k > 5
