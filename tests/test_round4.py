"""Round 4: drafts count every n-gram of the texts; what is asked meets the counts where they are made."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewright.operators import ngrams as N
from notewright.plans.text_queries import ngram_draft, ngram_draft_fallback
from notewright.queries import ORACLE


def _plain(rows, n_max):
    out = {}
    for _, t in rows:
        for n in range(1, n_max + 1):
            for i in range(len(t) - n):
                k = (n, " ".join(t[i : i + n]), t[i + n])
                out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("batch", ["10000", "7", "1"])
def test_what_is_asked_leaves_with_its_counts_and_nothing_else(spark, batch):
    rng = random.Random(9)
    rows = [(i, [rng.choice(["a", "b", "ab", "é"]) for _ in range(rng.randint(0, 40))]) for i in range(40)] + [(99, [f"w{i}" for i in range(3000)])]
    want = _plain(rows, 3)
    grams = sorted({k[:2] for k in want if k[0] > 1})
    asked = set(rng.sample(grams, len(grams) // 2)) | {(2, "no such"), (3, "a b none"), (1, "a")}
    d = spark.createDataFrame(rows, "i long, t array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # n-grams go on over batches
    try:
        got = N.asked_counts(d, "t", spark.createDataFrame(sorted(asked), "n int, ngram string"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({r[:3] for r in got})
    assert {(r["n"], r["ngram"], r["next_token"]): r["cnt"] for r in got} == {k: v for k, v in want.items() if k[0] == 1 or k[:2] in asked}


@pytest.mark.parametrize("batch", ["10000", "7", "1"])
def test_the_best_next_tokens_are_those_of_all_counts(spark, batch):
    rows = [(i, random.Random(i).choices(["a", "b", "ab", "é"], k=i)) for i in range(60)]
    d = spark.createDataFrame(rows, "i long, t array<string>")
    asked = spark.createDataFrame([(2, "a b"), (2, "b é"), (3, "a a a"), (3, "é ab b"), (1, "a")], "n int, ngram string")
    best = {}
    for (n, g, x), c in _plain(rows, 3).items():
        if n == 1 or g in ("a b", "b é", "a a a", "é ab b"):
            best[n, g] = min(best.get((n, g), (0, "")), (-c, x))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = N.best_next(N.asked_counts(d, "t", asked, 3, best=True)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["n"], r["ngram"]): (-r["cnt"], r["next_token"]) for r in got} == best


def test_every_place_is_counted_whatever_is_asked(spark, monkeypatch):
    rows = [(0, [f"w{i}" for i in range(3000)]), (1, ["w1", "w2", "x"] * 5)]

    def windows(*_):
        def run(batches):
            for b in batches:
                w = [x for x in b.column("w").to_pylist() if not x.endswith("\0")]
                yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int32()), "ngram": [""], "next_token": [""], "cnt": [len(w)]})

        return run

    monkeypatch.setattr(N, "_runs", windows)
    asked = spark.createDataFrame([(2, "w1 w2"), (3, "w7 w8 w9")], "n int, ngram string")
    got = N.asked_counts(spark.createDataFrame(rows, "i long, t array<string>"), "t", asked, 3)
    assert got.agg(F.sum("cnt")).first()[0] == sum(len(t) - 1 for _, t in rows)


@pytest.mark.parametrize("query", [ngram_draft, ngram_draft_fallback])
def test_drafts_of_odd_texts_equal_sql(spark, tmp_path, query):
    """Null, empty, without words, one to six words, one word over and over, copies, NUL between words; building starts no job."""
    rng = random.Random(4)
    texts = [None, "", " .,! ", "a", *(" ".join("abcdef"[:k]) for k in range(2, 7)), "la " * 500, "x\0y\0z x\0y x\0y\0z", "é a é b a_1 b"]
    texts += [" ".join(rng.choice(["a", "b", "ab", "A", "0"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += texts[-3:]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1).write.parquet(path)
    sc = spark.sparkContext
    query(spark, str(tmp_path))  # reads the schema
    sc.setJobGroup(query.__name__, "drafts")
    try:
        built = query(spark, str(tmp_path))
        jobs = sc.statusTracker().getJobIdsForGroup(query.__name__)
        got = sorted(tuple(r) for r in built.collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 1  # of the schema
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert got == sorted(c.execute(ORACLE[query.__name__]).fetchall())
