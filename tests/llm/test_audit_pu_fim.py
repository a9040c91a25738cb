"""Filter audit, positive-unlabelled quality and fill-in-middle against plain versions, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright.llm import audit, fim, puquality
from notewright.llm.oracles import audit_sql, fim_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, key string, n string, part string, good string, trusted string, x string, f_key string, output string"
CLASH = (1, 7, "key", "n", "part", "good", "trusted", "x", "f_key", "output")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for i in range(120):
        n = r.choice([0, 1, 3, 60, 199, 200, 260])
        t = r.choice([" ", "\n"]).join(r.choice(["alpha", "BETA", "c", f"w{r.randrange(400)}", "é🙂", "a#b"][: r.choice([1, 4, 5, 6])]) for _ in range(n))
        out.append((i, t, r.choice(["s1", "s2", "", None])))
    hot = " ".join(f"h{i}" for i in range(210))
    out += [(200 + i, hot, f"s{i % 3}") for i in range(60)]
    out += [(3, out[3][1], "s2"), (3, out[3][1], "s2"), (None, hot, "s1"), (None, None, None), (500, None, "s1"), (501, "", "s1"), (502, "x " * 30_000, "s2"), (503, "<P>", "s1"), (504, "A<", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, *CLASH) for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    r = random.Random(3)
    said = [(i, r.choice([0, 1, 1, None]), r.choice([0, 0, 1])) for i in range(150)]
    return spark.createDataFrame([*said, (0, 1, 0), (0, 0, 1), (None, 1, 1), (9_999, 1, 1)], "doc_id long, quality int, toxic int")


def plain_audit(rows, labels):
    """One walk over all documents for each order."""
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    fails = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        e = d is not None and any(t == (u or "") and c is not None and c < d for c, u, _ in rows)
        conditions = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), e]
        fails.append("".join(x for x, f in zip("ABCDE", conditions, strict=True) if f))
    parts = {s or "" for _, _, s in rows}
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for p in parts:
            mine = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == p]
            for i, x in enumerate(order):
                left = [(d, f) for d, f in mine if not set(f) & set(order[:i])]
                gone = [(d, f) for d, f in left if x in f]
                out[p, order, i + 1] = [
                    len(left) - len(gone), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
    total = {(p, x): sum(v[1] for (q, o, i), v in out.items() if q == p and o[i - 1] == x) for p in parts for x in "ABCDE"}
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_a_walk_over_all_documents(rows, docs, labels):
    got = audit.audit(docs, labels).select(AUDIT).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, labels.collect())


def test_audit_of_empty_tables(spark, docs, labels):
    assert audit.audit(docs.limit(0), labels).count() == 0
    none = audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("kept")).collect()[0]
    assert none[0] == 0 and none[1] == 0 and none[2] > 0


def test_audit_takes_other_filters(spark, docs, labels):
    two = {"S": lambda t: F.length(t) < 10, "U": lambda t: t.contains("BETA")}
    got = audit.audit(docs, labels, part="lang", filters=two)
    assert got.count() == 6 * 3
    first = got.filter("filter_order = 'SUE' and step = 1").collect()[0]
    assert first["removed"] == docs.filter("length(coalesce(text, '')) < 10").count()


def test_audit_rows_follow_cells_not_documents(spark, labels):
    many = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    cells = audit.cells(audit.masks(many, labels))
    assert sorted((r["mask"], r["n"]) for r in cells.collect()) == [(1, 1), (17, 4_999)]


def test_cut_equals_tokens(rows):
    for d, t, _ in rows:
        t, key = t or "", f"1:{'' if d is None else d}"
        tokens = TOKEN.findall(t)
        n, form, a, b, out = fim.cut(t, key)
        assert n == len(tokens)
        h = hashlib.sha256(key.encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        i, j = sorted(x % (n + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            assert (form, a, b, out) == ("plain", None, None, t)
        else:
            want = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            assert (form, out, a, b) == (*want, len(p), len(m))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzA Z<P>é\n🙂1ſK", max_size=80), st.integers(0, 90))
def test_starts_and_ranks(text, k):
    at = [m.start() for m in TOKEN.finditer(text)]
    bits = fim.starts(text)
    assert [i for i in range(len(text)) if bits >> i & 1] == at
    assert fim.ranked(bits, k, len(text)) == (at[k] if k < len(at) else len(text))


def test_cut_is_linear_in_a_long_text():
    text = "word, é " * 500_000
    n, form, a, b, out = fim.cut(text, "1:1")
    assert n == 500_000 * 5 and len(out) == len(text) + 9 * (form != "plain")


def test_outputs_restore_every_text(rows, docs):
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.select("doc_id", "back").collect()]
    assert sorted(got, key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_ids_of_any_size_pass(spark):
    ids = [2**53 + 1, -(2**62), None]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert {r["doc_id"] for r in fim.transform(docs).collect()} == set(ids)
    assert {r["doc_id"] for r in puquality.featured(docs, docs.selectExpr("doc_id", "1 as quality")).collect()} == set(ids)


@pytest.mark.parametrize(("f", "sql"), [(lambda d, n: audit.audit(d, n), audit_sql()), (lambda d, n: fim.digests(fim.transform(d)), fim_sql())])
def test_sql_agrees_on_odd_rows(rows, docs, labels, f, sql):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    documents = pd.DataFrame([r for r in rows if r[0] is not None], columns=["doc_id", "text", "source"])  # noqa: F841
    said = labels.toPandas()  # noqa: F841
    c.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from documents")
    c.execute("create table labels as select * from said")
    d = f(docs.filter("doc_id is not null"), labels)
    r = c.sql(sql)
    at = [r.columns.index(x) for x in d.columns]
    assert sorted(map(str, (tuple(x) for x in d.collect()))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


# Positive-unlabelled quality.


def plain_features(text):
    """The features by loops over characters and words."""
    def kind(c):
        if ord(c) > 127:
            return 7
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:!?'\"()-" else 6

    x = [0.0] * puquality.D
    if not text:
        return x
    for a, b in itertools.pairwise(text):
        x[8 * kind(a) + kind(b)] += 1
    x = [np.log1p(1000 * v / len(text)) for v in x]
    w = text.split()
    if w:
        lines = [s for s in text.split("\n") if s.strip()]
        triples = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        x[64:] = [
            np.log(1 + len(w)), min(50, sum(map(len, w)) / len(w)), len(set(w)) / len(w), 1 - len(triples) / (len(w) - 2) if len(w) > 2 else 0, 1 - len(set(lines)) / len(lines), np.log(1 + len(w) / len(lines)),
            sum(v.isalpha() for v in w) / len(w), sum(v.isupper() for v in w) / len(w), sum(not v[0].isalnum() for v in w) / len(w), np.log(1 + max(map(len, w))),
        ]
    return x


@pytest.mark.parametrize("text", [None, "", " \n\t ", "one", "One two, two!\nOne two, two!\n\nÉ ### 12", "ab " * 900_000, "x" * (2**20 + 5), "a\x85b c"])
def test_features_equal_loops(text):
    assert np.allclose(puquality.features(text), plain_features(text), atol=1e-9)


def plain_risk(z, trusted, w, prior):
    g = z @ w
    loss = lambda m: np.log1p(np.exp(-np.abs(m))) + np.maximum(-m, 0)
    return prior * loss(g[trusted]).mean() + max(0.0, loss(-g).mean() - prior * loss(-g[trusted]).mean())


def made_up(n, seed=1, prior=0.6):
    r = np.random.default_rng(seed)
    y = r.random(n) < prior
    x = r.normal(size=(n, puquality.D))
    x[:, :3] += 1.3 * np.where(y, 1, -1)[:, None]
    z = np.concatenate([np.ones((n, 1)), x], axis=1)
    return z, y & (r.random(n) < 0.5), y


def test_risk_has_its_derivatives_and_never_rises():
    z, trusted, y = made_up(4_000)
    sums = lambda w: puquality.risk_sums(z, trusted, w)
    w0 = np.random.default_rng(2).normal(size=puquality.D + 1) * 0.05
    s = puquality._unpack(sums(w0))
    grad = s["gu"] - 0.6 * s["zp"]
    e = 1e-5
    for k in (0, 1, 2, 40):
        d = np.zeros(puquality.D + 1)
        d[k] = e
        unclamped = lambda w: 0.6 * np.logaddexp(0, -(z[trusted] @ w)).mean() + np.logaddexp(0, z @ w).mean() - 0.6 * np.logaddexp(0, z[trusted] @ w).mean()
        assert abs((unclamped(w0 + d) - unclamped(w0 - d)) / (2 * e) - grad[k]) < 1e-6
    w, risk, path = puquality.fit_risk(sums, 0.6, ridge=0.01)
    assert all(a >= b for a, b in itertools.pairwise(path))
    penalty = 0.005 * (w[1:] @ w[1:]) + 0.5e-6 * w[0] ** 2
    assert abs(plain_risk(z, trusted, w, 0.6) + penalty - risk) < 1e-9
    assert (((z @ w) > 0) == y).mean() > 0.93


def test_convex_minimum_is_reached_where_the_risk_stays_positive():
    z, trusted, _ = made_up(6_000, seed=4)
    sums = lambda w: puquality.risk_sums(z, trusted, w)
    w, risk, _ = puquality.fit_risk(sums, 0.55, ridge=0.2)
    r = np.random.default_rng(0)
    for _ in range(200):
        v = w + r.normal(size=len(w)) * r.choice([1e-3, 1e-2, 1e-1])
        assert plain_risk(z, trusted, v, 0.55) + 0.1 * (v[1:] @ v[1:]) + 0.5e-6 * v[0] ** 2 >= risk - 1e-6


def test_prior_is_found_from_scores():
    r = np.random.default_rng(5)
    for prior in (0.3, 0.6, 0.9):
        u = np.where(r.random(40_000) < prior, r.beta(5, 2, 40_000), r.beta(2, 6, 40_000))
        h = lambda x: np.histogram(x, 256, (0, 1))[0]
        assert abs(puquality.best_bin(h(u), h(r.beta(5, 2, 8_000))) - prior) < 0.06


def test_stretch_meets_the_prior():
    m, c = np.linspace(-2, 2, 401), np.ones(401)
    c[m > 0] = 3
    a = puquality.stretch(m, c, 0.7)
    assert abs((c @ (1 / (1 + np.exp(-a * m)))) / c.sum() - 0.7) < 1e-6


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def given_tables(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_quality(spark, given_tables):
    d, said = given_tables
    got = puquality.score(d, said).toPandas().merge(said.toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(held)).all() and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    test = got[got.held_out]
    good, bad = test[test.quality == 1].score, test[test.quality == 0].score
    assert np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good]) > 0.97
    assert (good >= 0.3).mean() > 0.97


def test_held_out_rows_and_bad_labels_are_not_learned(spark, given_tables):
    d, said = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = said.withColumn("quality", F.when(out, 1 - F.col("quality")).when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("quality")))
    other = d.withColumn("text", F.when(out, F.lit("changed text")).otherwise(F.col("text")))
    scores = lambda x, y: {r["doc_id"]: r["score"] for r in puquality.score(x, y).collect()}
    a, b, c = scores(d, said), scores(d, turned), scores(other, said)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6
    assert max(abs(a[k] - c[k]) for k in a if not held(k)) < 1e-6


def test_scores_of_odd_rows_and_empty_tables(spark, docs, labels):
    got = puquality.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["doc_id"] is None for r in got) == 2 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert puquality.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in puquality.score(docs, labels.limit(0)).collect()} == {0.5}
