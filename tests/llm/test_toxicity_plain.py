"""The toxicity operator's parts against plain versions: features by loops, trees by exhaustive search, calibration by the min-max formula, the whole by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from notewright.llm import toxicity as T

LEXICON = ({"idiot": 3.0, "moron": 2.0, "loser": 1.5}, {"stupi": 2.5, "idiot": 1.0})


def plain_features(text):
    raw = (text or "").split()
    n = max(1, len(raw))
    bare = []
    for w in raw:
        w = w.lower()
        while w and w[0] in T.STRIP:
            w = w[1:]
        while w and w[-1] in T.STRIP:
            w = w[:-1]
        bare.append(w)
    hits = [(i, LEXICON[0][w]) for i, w in enumerate(bare) if w in LEXICON[0]]
    stems = [LEXICON[1][w[:5]] for w in bare if len(w) > 5 and w[:5] in LEXICON[1]]
    odd, leet = [], []
    for i, w in enumerate(bare):
        if not w.isalpha() and T.OBFUSCATED.search(w):
            odd.append(i)
            read = "".join(dict(zip("0134578@$!", "oieastbasi", strict=True)).get(c, c) for c in w)
            if read in LEXICON[0] or read.replace("*", "") in LEXICON[0]:
                leet.append(i)
    near = 0
    for i in {i for i, _ in hits} | set(leet):
        near += any(bare[j] in T.YOU for j in range(max(0, i - 3), min(len(bare), i + 4)))
    t = text or ""
    chars = max(1, len(t))
    values = [v for _, v in hits]
    return [
        math.log(1 + len(raw)), len(hits) / n, sum(values) / n, max([0.0, *values]), float(len({bare[i] for i, _ in hits})), len(stems) / n, sum(stems) / n, max([0.0, *stems]), len(leet) / n, near / n,
        sum(w in T.YOU for w in bare) / n, sum(c.isupper() for c in t) / chars, sum(len(w) > 1 and w.isupper() for w in raw) / n, t.count("!") / n, sum(c in ".,;:?" for c in t) / n, sum(c in "#*$%&|<>@" for c in t) / n, len(odd) / n,
    ]


@pytest.mark.parametrize("text", [None, "", " \n", "You IDIOT, you!", "such a m0ron and 1d1ot; stupidity", "I d i o t", "calm words " * 50_000 + "loser", "Nice day. Idiotic? you are far from all the words here moron", "É#ÉÉ *** <b>you</b> id*iot"])
def test_features(text):
    assert np.allclose(T.features([text], LEXICON)[0], plain_features(text), atol=1e-12)


def plain_trees(x, y, rounds, depth, rate, bins, least, l2):
    """Boosting with every split found by trying all, and the training rows' scores."""
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    score = np.full(len(y), math.log(p0 / (1 - p0)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-6, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
                for f, cs in enumerate(cuts):
                    for c in cs:
                        a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                        if len(a) < least or len(b) < least:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2) - whole
                        if gain > best[0] + 1e-12:
                            best = (gain, (a, b))
                below += list(best[1] or (rows, rows[:0]))
            nodes = below
        for rows in nodes:
            score[rows] += rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize(("depth", "least"), [(1, 2), (2, 3), (3, 8)])
def test_trees_equal_exhaustive_search(depth, least):
    r = np.random.default_rng(depth)
    x = r.normal(size=(90, 3))
    x[:, 2] = np.round(x[:, 2])  # ties
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=90) > 0).astype(float)
    got = T.Trees(rounds=6, depth=depth, rate=0.3, bins=10, least=least, l2=1.0).fit(x, y).predict(x)
    assert np.allclose(got, plain_trees(x, y, 6, depth, 0.3, 10, least, 1.0), atol=1e-9)


def test_isotonic_equals_the_min_max_formula():
    r = np.random.default_rng(3)
    s, y = r.random(40), (r.random(40) < 0.5).astype(float)
    knots, values = T.isotonic(s, y)
    order = np.argsort(s)
    y, s = y[order], s[order]
    want = [max(min(y[j : k + 1].mean() for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
    at = 0
    for knot, value in zip(knots, values, strict=True):  # each knot is the mean score of a block of one value
        block = [i for i in range(at, 40) if abs(want[i] - value) < 1e-12]
        block = block[: next((n for n, i in enumerate(block) if i != at + n), len(block))]
        assert block and abs(s[block].mean() - knot) < 1e-12
        at = block[-1] + 1
    assert at == 40


def test_whole_scores_by_hand(spark):
    """Scores of all rows from the lexicons, folds and parts as the docstring has them, and a bound on rows that repeat a doc_id."""
    r = random.Random(8)
    words = "river stone cloud green walk paper light under night seven".split()
    rows, labels = [], []
    for i in range(160):
        bad = r.random() < 0.5
        w = [r.choice(words) for _ in range(20)]
        if bad and r.random() < 0.9:
            w[r.randrange(20)] = r.choice(["idiots!", "MORON", "scum"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(None, "you scum"), (2**60, None)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, lexicon = T.train(d, lab)
    x = np.array([T.dense(t, *lexicon, tuple(sorted({len(k) for k in lexicon[1]}))) for _, t in rows])
    raw = model.trees.predict(x)
    want = 0.999 * np.interp(raw, *model.knots) + 0.001 * raw
    got = {g["doc_id"]: g["score"] for g in T.score(d, lab).collect()}
    assert all(abs(got[i] - v) < 1e-9 for (i, _), v in zip(rows, want, strict=True))
    many = d.unionByName(spark.createDataFrame([rows[3]] * 500, d.schema))
    assert T.score(many, lab, max_rows=100).count() == len(rows) + 500
