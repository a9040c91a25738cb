"""Findings of round 3: zero times, units of tokenisers, n-grams of one shuffle, blocks of vectors."""

from __future__ import annotations

import collections
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from notewright.functions import kquants as K
from notewright.functions import scalars as X
from notewright.functions import tokenizers as Z
from notewright.operators import joins as J
from notewright.operators import ngrams as N
from notewright.operators import stats
from notewright.operators import vectors as V
from notewright.plans import tool_queries as T
from notewright.queries import ORACLE, QUERIES
from notewright.streaming import slots


def test_throughput_of_no_time_is_infinite(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 4.0), ("c", None)], "k string, ns double")
    got = {r["k"]: r for r in stats.mean_stdev(d.withColumn("t", stats.throughput(F.lit(2), F.col("ns"))), ["k"], "t").collect()}
    assert got["a"]["mean"] == math.inf
    assert math.isnan(got["a"]["stdev"])
    assert got["b"]["mean"] == 5e8
    assert got["c"]["mean"] is None


def _pieces():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return list(dict.fromkeys([*"abc", "▁", "▁▁", *words, *["▁" + w for w in words]]))


def _texts():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdé  \t\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_units_give_the_ids_of_whole_texts():
    pieces = _pieces()
    scores, ids = {p: -float(i) for i, p in enumerate(pieces)}, {p: i + 1 for i, p in enumerate(pieces)}
    raw = {p.replace("▁", " ").encode(): i for p, i in ids.items()}
    for make in (lambda: Z.ScorePieces(scores, ids, {}), lambda: Z.Unigram(scores, ids), lambda: Z.GreedyBytes(raw)):
        parts, whole = make(), make()
        assert parts.apart
        whole.apart = False
        assert [parts.encode(t) for t in _texts()] == [whole.encode(t) for t in _texts()]


def test_a_piece_over_two_words_keeps_texts_whole():
    assert not Z.Unigram({"a▁b": -1.0, "a": -2.0}, {"a▁b": 1, "a": 2}).apart
    assert Z.GreedyBytes({b"a": 1, b"b": 2, b" ": 3, b"a b": 4}).encode("a b") == [4]


def test_greedy_match_looks_no_further_than_a_token_may_come():
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __contains__(self, x):
            Counted.n += 1
            return super().__contains__(x)

    ids = Counted({bytes([i]): i for i in range(256)} | {b"x" * 128: 256})
    assert Z.GreedyBytes(ids).encode("abc" * 100) == list(b"abc" * 100)
    assert Counted.n <= 2 * 300


def test_equal_words_are_encoded_once(monkeypatch):
    n = []
    merge = Z._merge
    monkeypatch.setattr(Z, "_merge", lambda *a: n.append(1) or merge(*a))
    scores = {p: -float(i) for i, p in enumerate(_pieces())}
    Z.ScorePieces(scores, {p: i for i, p in enumerate(scores)}, {}).encode("abc cab " * 50)
    assert len(n) <= 4


def test_ids_leave_a_worker_in_slices(spark):
    rows = [(i, None if i % 50 == 7 else "ab " * (i % 5)) for i in range(3 * Z.SLICE + 5)]
    got = {r["i"]: r["ids"] for r in Z.encode(spark.createDataFrame(rows, "i long, text string").coalesce(1), Z.GreedyBytes({b"a": 1, b"b": 2, b" ": 3}), ["i"]).collect()}
    assert got == {i: None if t is None else [1, 2, 3] * (i % 5) for i, t in rows}


def _plain_counts(rows, n_max):
    out = collections.Counter()
    for _, t in rows:
        for n in range(1, n_max + 1):
            out.update((n, " ".join(t[i : i + n]), t[i + n]) for i in range(len(t or []) - n))
    return out


def _token_rows():
    rng = random.Random(5)
    return [(i, [rng.choice(["a", "b", "ab", "é"]) for _ in range(rng.randint(0, 40))]) for i in range(60)]


def test_windows_give_the_counts_of_all_orders_by_one_row_a_place(spark):
    rows = _token_rows()
    d = spark.createDataFrame(rows, "i long, t array<string>")
    for batch in ("10000", "7"):  # runs go on over batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for got in (N.counts(d, "t", 4), N.counts_of_all([d.filter("i % 2 = 0"), d.filter("i % 2 = 1")], "t", 4)):
                got = got.collect()
                assert {(r["n"], r["ngram"], r["next_token"]): r["cnt"] for r in got} == _plain_counts(rows, 4)
                assert len(got) == len(_plain_counts(rows, 4))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_asked_counts_hold_all_that_is_asked_and_little_more(spark):
    rows = [(0, [f"w{i}" for i in range(3000)]), (1, ["w1", "w2", "x", "w1", "w2", "x"])]
    d = spark.createDataFrame(rows, "i long, t array<string>")
    asked = spark.createDataFrame([(1, "w1"), (2, "w1 w2"), (3, "w7 w8 w9")], "n int, ngram string")
    got = {(r["n"], r["ngram"], r["next_token"]): r["cnt"] for r in N.asked_counts(d, "t", asked, 3).collect()}
    want = _plain_counts(rows, 3)
    assert all(want[k] == v for k, v in got.items())
    assert {k for k in want if k[1] in ("w1", "w1 w2", "w7 w8 w9")} <= set(got)
    assert sum(k[0] > 1 for k in got) < 100


def test_cosines_in_slices(spark, monkeypatch):
    """Nulls, zero vectors, other lengths; many more rows than a slice of 1,000 queries takes."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1500)] + [(2000, None), (2001, [0.0] * 3), (2002, [0.0] * 3), (2003, [1.0]), (2004, [1.0, None, 2.0])]
    d = spark.createDataFrame(rows, "i long, a array<double>").coalesce(1)
    some = d.filter("i % 500 = 0 or i > 2000")

    def cos(x, y):
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            return None
        nx, ny = (math.sqrt(sum(v * v for v in z)) for z in (x, y))
        return float(nx == ny) if nx * ny == 0 else sum(p * q for p, q in zip(x, y, strict=True)) / nx / ny

    of = dict(rows)
    got = {(r["a_id"], r["b_id"]): r["cos"] for r in V.cosine_pairs(d, "i", "a", some).collect()}
    assert len(got) == len(rows) * some.count()
    for (p, q), c in got.items():
        want = cos(of[p], of[q])
        assert (c is None) == (want is None)
        assert c is None or abs(c - want) < 1e-12
    top = {}
    for r in V.top_k(d.filter("i % 500 = 0 and a is not null"), d.filter("i < 1500"), "i", "a", 7).orderBy("query_id", "rank").collect():
        top.setdefault(r["query_id"], []).append(r["i"])
    ids = range(1500)
    assert top[0] == sorted(ids, key=lambda j: (-round(cos(of[0], of[j]), 9), j))[:7]
    assert top[500] == sorted(ids, key=lambda j: (-round(cos(of[500], of[j]), 9), j))[:7]


def test_a_task_keeps_its_best_over_its_slices(spark):
    """Before, every batch gave k rows of each query."""
    d = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(400)], "i long, a array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        plan = V.top_k(d.filter("i = 0"), d, "i", "a", 5)
        assert plan.count() == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert V.MOST_PRODUCTS <= 1_000_000


def test_codec_rows_leave_a_worker_in_slices(spark, monkeypatch):
    """Before, a worker held the values of a whole batch as Python numbers."""
    del monkeypatch
    d = spark.createDataFrame([(i, [float(i)] * 4) for i in range(2 * K.SLICE + 3)], "i long, a array<double>").coalesce(1)
    got = K.decode(K.encode(d, "a", "tq2_0", ["i"]), "blocks", "tq2_0", ["i"]).select("i", F.get("v", F.lit(0)).alias("v")).collect()
    assert {r["i"]: (r["v"] > 0) for r in got} == {i: i > 0 for i in range(2 * K.SLICE + 3)}
    assert K.SLICE <= 1000


def test_partial_answers_clean_a_text_once(spark):
    """The four rows of a text are made of its cleaned beginning."""
    plan = T.response_diffs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_replace")


def _plain_fnv(raw):
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_texts_are_hashed_side_by_side(spark):
    """Nulls, empty texts, many lengths, slices of a batch; before, each byte was a string of an array of the row's."""
    rng = random.Random(7)
    texts = [None if i % 17 == 3 else "".join(rng.choice("aé🤖\n ") for _ in range(rng.choice((0, 1, 5, 90, i)))) for i in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r["i"]: r["f"] for r in d.select("i", X.fnv1a(F.col("t")).alias("f")).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {i: None if t is None else f"{_plain_fnv(t.encode()):016x}" for i, t in enumerate(texts)}
    raw = [bytes([i % 256]) * (1000 + i) for i in range(100)]
    sizes = np.array([len(r) for r in raw])
    assert X._fnv1a(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes).tolist() == [_plain_fnv(r) for r in raw]
    assert "aggregate(" not in d.select(X.fnv1a(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def _odd_documents(path, rows):
    ids, langs, texts = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "text": pa.array(texts, pa.string())}), f"{path}/documents.parquet")


def _by_sql(name, path):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet'")
    return sorted(c.sql(ORACLE[name]).fetchall(), key=str)


def test_drafts_are_verified_as_lists_without_a_join(spark, tmp_path):
    """Texts without a word, null ids and texts, an id with several texts, drafts that are refused or not."""
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "a", " ".join(words[: i % 11])) for i in range(30)] + [(100, "a", None), (101, "a", ""), (None, "a", "x y"), (200, "a", "p q"), (200, "a", " ".join(words)), (201, "a", "é - ?")]
    _odd_documents(tmp_path, rows)
    got = QUERIES["speculative_verify"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == _by_sql("speculative_verify", tmp_path)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "Generate" not in plan


def test_lists_and_rows_of_a_draft_agree(spark):
    pairs = [(1, ["a", "b"], ["a", "b"]), (2, ["a", "b"], ["a"]), (3, ["a"], ["a", "b"]), (4, ["a", "b"], ["x", "b"]), (5, ["a", None, "c"], ["a", None, "d"])]
    d = spark.createDataFrame(pairs, "key long, t array<string>, g array<string>")
    got = {r["key"]: tuple(r["x"]) for r in d.select("key", slots.speculate_lists(F.col("t"), F.col("g")).alias("x")).collect()}
    side = lambda c: d.select("key", F.posexplode(c).alias("pos", "id"))
    assert got == {r["key"]: (r["accepted"], r["next_id"]) for r in slots.speculate(side("t"), side("g")).collect()}
    none = spark.createDataFrame([(["a"], None)], "t array<string>, g array<string>").select(slots.speculate_lists(F.col("t"), F.col("g")).alias("x")).first()["x"]
    assert tuple(none) == (0, "a")


def test_words_are_counted_on_strings():
    rng = random.Random(8)
    for _ in range(3000):
        same = [rng.choice(["", "a", "ab" * 40]) for _ in range(rng.randint(0, 6))]
        a, b = (same + [rng.choice(["", "a", "ab", "abc"]) for _ in range(rng.randint(0, 2))] or [""] for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert J.shared_words("\0".join(a).encode(), "\0".join(b).encode()) == want


def test_nearest_prefixes_shuffle_texts_once_and_equal_sql(spark, tmp_path, monkeypatch):
    """Copies, texts that end in blanks, characters that sort before a blank (0 and 1 among them), null texts and languages; more ranges than rows a language."""
    rng = random.Random(9)
    words = ["a", "ab", "", "a\tb", "a\nb", "\x01", "\x01\x01", "a\x01", "a!", "é", "🤖", "a\x00"]
    rows = [(i, rng.choice(["x", "y", None, "z"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for i in range(300)]
    rows += [(1000 + i, "x", "the same words " * 30) for i in range(40)] + [(2000 + i, c, None) for i, c in enumerate("xxyw")]
    _odd_documents(tmp_path, rows)
    want = _by_sql("longest_common_prefix", tmp_path)
    for ranges in ("1", "7", "60"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = QUERIES["longest_common_prefix"](spark, str(tmp_path))
            assert sorted(map(tuple, got.collect()), key=str) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = []
    monkeypatch.setattr(J, "materialise", lambda d, name: kept.append(d) or d)
    J.nearest_prefixes(spark.read.parquet(f"{tmp_path}/documents.parquet"), "lang", "text", "doc_id")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kept[0].filter("x_words is not null").count() <= 2 * ranges  # all that is written of the texts
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
