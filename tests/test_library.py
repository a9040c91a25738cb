"""Literal cases of samplers, excerpts, contracts, sources, codecs and streams."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from notewright.functions import codecs, contracts, strings
from notewright.functions import tensor as T
from notewright.operators import excerpts as X
from notewright.operators import sampling as S
from notewright.plans import extraction
from notewright.plans.programs import PROGRAMS
from notewright.sources import gguf, notes
from notewright.streaming import memory


def left(spark, f, p):
    c = spark.createDataFrame([("c", i, math.log(x)) for i, x in enumerate(p)], "ctx string, id long, logit double")
    out = f(c).select("ctx", "id", "logit")
    return [round(r["p"], 5) for r in S.softmax(out).orderBy(F.desc("p"), "id").collect()]


P4 = [0.1, 0.2, 0.3, 0.4]


@pytest.mark.parametrize(("f", "p", "want"), [
    (lambda c: S.temperature(c, 1.0), P4, [0.4, 0.3, 0.2, 0.1]), (lambda c: S.temperature(c, 0.0), P4, [1.0]),
    (lambda c: S.top_k(c, 1), P4, [1.0]), (lambda c: S.top_k(c, 3), P4, [0.44444, 0.33333, 0.22222]), (lambda c: S.top_k(c, 0), P4, [0.4, 0.3, 0.2, 0.1]),
    (lambda c: S.top_p(c, 0.0), P4, [1.0]), (lambda c: S.top_p(c, 0.7), P4, [0.57143, 0.42857]), (lambda c: S.top_p(c, 0.8), P4, [0.44444, 0.33333, 0.22222]), (lambda c: S.top_p(c, 1.0), P4, [0.4, 0.3, 0.2, 0.1]),
    (lambda c: S.min_p(c, 0.24), P4, [0.4, 0.3, 0.2, 0.1]), (lambda c: S.min_p(c, 0.26), P4, [0.44444, 0.33333, 0.22222]), (lambda c: S.min_p(c, 0.51), P4, [0.57143, 0.42857]), (lambda c: S.min_p(c, 0.76), P4, [1.0]),
    (lambda c: S.typical(c, 0.5), [0.97, 0.01, 0.01, 0.01], [1.0]), (lambda c: S.typical(c, 0.5), [0.4, 0.2, 0.2, 0.2], [0.33333] * 3),
    (lambda c: S.xtc(c, 1.0, 0.09), [0.4, 0.3, 0.2, 0.1], [1.0]), (lambda c: S.xtc(c, 1.0, 0.19), [0.4, 0.3, 0.2, 0.1], [0.66667, 0.33333]), (lambda c: S.xtc(c, 1.0, 0.39), [0.4, 0.3, 0.2, 0.1], [0.4, 0.3, 0.2, 0.1]),
    (lambda c: S.top_n_sigma(c, 1.0), P4, [0.57143, 0.42857]), (lambda c: S.top_n_sigma(c, 0.0), P4, [0.4, 0.3, 0.2, 0.1]), (lambda c: S.top_n_sigma(c, 3.0), P4, [0.4, 0.3, 0.2, 0.1]),
])
def test_sampler_literals(spark, f, p, want):
    assert left(spark, f, p) == pytest.approx(want, abs=2e-5)


def test_dry_literal(spark):
    h = spark.createDataFrame([("c", i, t) for i, t in enumerate([0, 1, 2, 0, 1])], "ctx string, pos long, id long")
    assert left(spark, lambda c: S.dry(c, h, 1.0, 1.1, 2), [0.25] * 4) == pytest.approx([0.29692] * 3 + [0.10923], abs=2e-5)


def test_penalties_literal(spark):
    h = spark.createDataFrame([("c", 0, 0)], "ctx string, pos long, id long")
    assert left(spark, lambda c: S.penalties(c, h, 5, 50.0), [0.2] * 5)[:4] == pytest.approx([0.25] * 4, abs=2e-5)


def lines(*hits, n=20):
    return "\n".join("hit" if i in hits else "x" for i in range(n))


@pytest.mark.parametrize(("hits", "want"), [((3, 9), [(1, 11)]), ((3, 10), [(1, 5), (8, 12)]), ((0,), [(0, 2)]), ((19,), [(17, 20)])])
def test_block_merging(spark, hits, want):
    d = spark.createDataFrame([("e", 0, "2020-01-02", lines(*hits))], "entity string, row_no long, day string, text string").withColumn("day", F.to_date("day"))
    got = X.blocks(d, X.ExcerptSpec("hit", 2, 2, 20, 5, 5)).orderBy("block_no").collect()
    assert [(r["start"], r["end"]) for r in got] == want


def test_excerpt_cases(spark):
    spec = X.ExcerptSpec("(?i)hit", 0, 0, 3, 1, 1, blocks_per_note=2, question="\nQ\n")
    rows = [("a", 0, "2021-05-01", "hit one"), ("a", 1, "2020-01-01", " HIT ONE \n"), ("a", 2, None, "hit none"), ("a", 3, "2019-01-01", "hit\r\nx\rx\nx\nhit b\nx\nx\nx\nhit c"), ("b", 4, "2020-01-01", "nothing")]
    rows += [("c", 10 + i, f"20{10 + i}-01-01", f"hit {i}") for i in range(6)]
    d = spark.createDataFrame(rows, "entity string, row_no long, day string, text string").withColumn("day", F.to_date("day"))
    p = {r["entity"]: r for r in X.prompts(d, spec).collect()}
    assert set(p) == {"a", "c"}
    assert p["a"]["n_excerpts"] == 3
    assert "2021-05" in p["a"]["prompt"]
    assert "2020-01" not in p["a"]["prompt"]
    assert "hit c" not in p["a"]["prompt"]
    assert p["c"]["n_excerpts"] == 3
    assert "hit 0" in p["c"]["prompt"]
    assert "hit 5" in p["c"]["prompt"]
    assert "\n" not in p["c"]["prompt"]
    assert X.prompts(d, spec).collect() == X.prompts(d, spec).collect()


def test_programs_parse(spark):
    d = spark.createDataFrame([("a", 0, "2020-01-01", "seen for UC in 1998; colonoscopy report; colectomy; colon cancer")], "entity string, row_no long, day string, text string").withColumn("day", F.to_date("day"))
    for name, spec in PROGRAMS.items():
        assert X.prompts(d, spec).count() == 1, name


def test_note_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text('﻿p1,2020-01-02 03:04:05,d1,"line ""a""\nline b"\np2,NULL,d2,x,extra\np3,2020-01-02 03:04:05\n', encoding="utf-8")
    got = {r["entity"]: r for r in notes.read_notes(spark, str(tmp_path / "n.csv")).collect()}
    assert got["p1"]["text"] == 'line "a"\nline b'
    assert got["p2"]["day"] is None
    assert got["p3"]["text"] is None
    (tmp_path / "ids.txt").write_text(" p1 \n\np3\n")
    assert notes.read_ids(spark, str(tmp_path / "ids.txt")).count() == 2
    a = spark.createDataFrame([("x\ny", "1"), ("z", "2")], "answer string, id string")
    notes.write_answers(a, str(tmp_path / "out"))
    assert sorted(notes.read_answers(spark, str(tmp_path / "out")).collect()) == sorted(a.collect())


def test_bench_files(spark, tmp_path):
    row = {"build_commit": "abc", "test_time": "t", "avg_ts": 1.5, "n_prompt": 512, "flash_attn": True, "odd": 1}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "a.json").write_text(json.dumps([row]))
    (tmp_path / "a.csv").write_text("build_commit,test_time,avg_ts,n_prompt,flash_attn\nabc,t,1.5,512,true\n")
    rows = [notes.read_bench(spark, str(tmp_path / f"a.{x}")).select("build_commit", "avg_ts", "n_prompt", "flash_attn").collect() for x in ("jsonl", "json", "csv")]
    assert rows[0] == rows[1] == rows[2]
    assert rows[0][0]["flash_attn"] == 1
    (tmp_path / "b.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        notes.read_bench(spark, str(tmp_path / "b.csv"))


def test_gguf_files(spark, tmp_path):
    gguf.write(str(tmp_path / "a.gguf"), [("general.name", 8, "m"), ("n", 4, 7)], [("blk.0.w", 0, [4, 2], b"\0" * 32), ("out", 0, [2], b"\0" * 8)])
    (tmp_path / "bad.gguf").write_bytes(b"GGUX")
    (tmp_path / "cut.gguf").write_bytes((tmp_path / "a.gguf").read_bytes()[:60])
    d = gguf.read(spark, str(tmp_path)).cache()
    got = d.filter("path like '%a.gguf'").collect()
    assert {r["name"]: r["value"] for r in got if r["kind"] == "kv"} == {"general.name": '"m"', "n": "7"}
    assert {r["name"]: (r["dims"], r["n_bytes"]) for r in got if r["kind"] == "tensor"} == {"blk.0.w": ([4, 2], 32), "out": ([2], 8)}
    assert d.filter("kind = 'error'").count() == 2
    assert {r["block"]: r["percent"] for r in gguf.dump(d).collect()} == {"0": 80.0, "base": 20.0}
    assert {r["shard"] for r in gguf.split_plan(d, max_tensors=1).collect()} == {0, 1}


@pytest.mark.parametrize("kind", ["q8_0", "q4_0", "q5_0", "q4_1", "q5_1"])
def test_codecs_round_trip(spark, kind):
    d = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i * (F.col("id") + 1)) * 3).alias("a"))
    back = codecs.decode(getattr(codecs, kind)(F.col("a")), kind)
    err = d.select(F.array_max(F.zip_with("a", back, lambda x, y: F.abs(x - y))).alias("e")).agg(F.max("e")).collect()[0][0]
    assert err <= {"q8_0": 0.02, "q4_0": 0.4, "q5_0": 0.2, "q4_1": 0.25, "q5_1": 0.12}[kind]


def test_strings(spark):
    d = spark.createDataFrame([(r"a\nb\x41\\n\q", "text ends with <|en")], "a string, b string")
    r = d.select(strings.process_escapes(F.col("a")).alias("a"), strings.partial_stop(F.col("b"), "<|end|>").alias("b")).collect()[0]
    assert r["a"] == "a\nbA\\n\\q"
    assert r["b"] == 15
    assert strings.int_range("1,4-6,8-32*2") == [1, 4, 5, 6, 8, 16, 32]
    with pytest.raises(ValueError, match="never ends"):
        strings.int_range("1-5*1")


def test_contracts(spark):
    d = spark.createDataFrame([("Answer: Yes\n- colectomy; sigmoid, cecum; May; 2001\n- hartmann; rectum; Unknown; 1999",), ("Answer: R1",), ('{"indication":"x"}',)], "answer string")
    assert [(r["procedure"], len(r["segments"]), r["year"]) for r in contracts.parse_procedures(d).orderBy("no").collect()] == [("colectomy", 2, "2001"), ("hartmann", 1, "1999")]
    assert {r["value"] for r in contracts.parse_resection(d).filter("valid").collect()} == {"R1"}
    assert contracts.parse_report(d).filter("indication = 'x'").count() == 1


def test_extraction_retries(spark):
    def make():
        def f(texts):
            if len(texts) > 1 or texts[0] == "bad":
                raise RuntimeError("no slot")
            return [t.upper() for t in texts]

        return f

    p = spark.createDataFrame([("a", 0, "x"), ("b", 0, "bad"), ("c", 0, "y")], "entity string, chunk_no int, prompt string")
    got = {r["entity"]: (r["answer"], r["error"]) for r in extraction.extract(p, make).collect()}
    assert got == {"a": ("X", None), "b": (None, "no slot"), "c": ("Y", None)}
    with pytest.raises(ValueError, match="unknown prompt format"):
        extraction.prompt_suffix("none")


def test_gradients(spark):
    x = [0.3, -1.2, 0.7]
    d = spark.createDataFrame([(x, [1.0, 0.5, -0.2])], "x array<double>, g array<double>")

    def numeric(f):
        out = []
        for i in range(3):
            y = []
            for e in (1e-5, -1e-5):
                v = [a + e * (i == j) for j, a in enumerate(x)]
                y.append(sum(a * b for a, b in zip(f(v), [1.0, 0.5, -0.2], strict=True)))
            out.append((y[0] - y[1]) / 2e-5)
        return out

    silu = lambda v: [a / (1 + math.exp(-a)) for a in v]
    rms = lambda v: [a / math.sqrt(sum(b * b for b in v) / 3 + 1e-5) for a in v]
    soft = lambda v: [math.exp(a) / sum(map(math.exp, v)) for a in v]
    r = d.select(T.silu_back(F.col("g"), F.col("x")).alias("s"), T.rms_norm_back(F.col("g"), F.col("x")).alias("n"), T.soft_max_back(F.col("g"), T.soft_max(F.col("x"))).alias("m")).collect()[0]
    for got, f in ((r["s"], silu), (r["n"], rms), (r["m"], soft)):
        assert got == pytest.approx(numeric(f), abs=1e-6)


def test_sequence_memory(spark):
    c = spark.createDataFrame([(0, i, i) for i in range(6)], "seq long, cell long, pos long")
    assert [r["pos"] for r in memory.shift(memory.remove(c, 0, 1, 3), 0, 3, -1, -2).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert memory.copy(c, 0, 1, 2, 4).filter("seq = 1").count() == 2
    assert memory.window_keep(c, 2).count() == 2
    assert memory.chunk_keep(c, 4).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), (F.col("event_id") % 7).alias("token"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = memory.running_sequences(s).writeStream.outputMode("update").format("memory").queryName("seqs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: r["n"] for r in spark.sql("select seq, max(n) as n from seqs group by seq").collect()}
    assert got == {r["seq"]: r["count"] for r in e.groupBy("seq").count().collect()}
