"""The pipeline's stages against plain versions, with nulls, empty texts, repeated rows and an extra column, and its end to end run."""

from __future__ import annotations

import collections

import corpus_pipeline as P
from pyspark.sql import functions as F

from notewright.llm import jaccard, langid, mixing, secrets

SF = "/root/testdata/sf0.001"


def test_stages_hold_together(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    some = table.orderBy("doc_id").limit(3).collect()
    odd = [(None, None, None, None, None), (2**60 + 1, None, "en", "a", 0), (2**60 + 2, "", None, None, 0), (2**60 + 3, " \n", "xx", "b", 2), tuple(some[0]), tuple(some[1]), tuple(some[1])]
    docs = table.unionByName(spark.createDataFrame(odd, table.schema)).selectExpr("*", "'x' as size")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_duplicates", "secrets", "mix", "encode"]
    a = P.language_id(spark, docs, SF).cache()
    assert a.columns == docs.columns
    gone = {r["doc_id"] for r in langid.identify_documents(docs).filter("rejected").collect()}
    assert collections.Counter(r["doc_id"] for r in a.collect()) == collections.Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in gone)
    b = P.near_duplicates(spark, a, SF).cache()
    want = {r["component_id"] for r in jaccard.components(a, 5, 80).collect()}
    ids = [r["doc_id"] for r in b.collect()]
    assert set(ids) == want
    assert len(ids) == len(want)
    c = P.mask_secrets(spark, b, SF).cache()
    assert c.columns == docs.columns
    assert c.count() == b.count()
    assert {r["spans"] for r in secrets.scan(c).select("spans").collect()} == {""}
    m = P.mix(spark, c, SF).cache()
    assert m.columns == docs.columns
    took = {r["doc_id"]: r["taken"] for r in mixing.mix(c).collect()}
    words = collections.Counter()
    for r in m.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == collections.Counter({k: v for k, v in took.items() if v})
    e = P.encode(spark, m, SF).collect()
    assert len(e) == m.count()
    assert all(r["round_trip"] for r in e)
    assert all(r["n_tokens"] == len(r["ids"]) for r in e)
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_columns_with_helpers_names_pass_unchanged(spark):
    """Columns named as the stages' own helpers, and a very long text, come through every stage but the last as they were."""
    names = ["d_t", "d_no", "m_words", "m_blocks", "m_pass", "g_own", "p_key", "s_clean", "h", "other_columns", "g_key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = docs.limit(1).selectExpr("cast(99999999 as long) as doc_id", "repeat(concat(text, ' more of it. '), 200) as text", "lang", "source", "n_chars")
    docs = docs.unionByName(long)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{i}:{r['doc_id']}" for r in rows for i, n in enumerate(names)), name
        docs = P.store(out, "clashing")


def test_run(spark):
    assert P.run(spark, SF).count() > 150
    assert P.ORACLE_SQL is None
