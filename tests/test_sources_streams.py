"""Binary data sources, streamed tables and answers, epochs, table functions and templates, with restarts, damage and odd rows."""

from __future__ import annotations

import math
import os
import random
import struct
import time

import numpy as np
import pytest

from notewright.functions import templates
from notewright.operators import ngrams, rowwise, training
from notewright.plans import extraction
from notewright.sources import files
from notewright.streaming import answers, count_tables


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    files.register(spark)


# Files


def load(spark, form, path, **options):
    return spark.read.format(form).options(path=path, **{k: str(v) for k, v in options.items()}).load()


@pytest.mark.parametrize(("kind", "near"), [("F64", 0), ("F32", 1e-6), ("F16", 2e-2), ("Q8_0", 5e-2), ("I32", 0)])
def test_tensors_round_trip_by_ranges(spark, tmp_path, kind, near):
    r = np.random.default_rng(3)
    rows = [(f"t{i % 3}", 10_000_000_000 + i, np.rint(r.normal(size=64) * 9).tolist() if kind == "I32" else r.normal(size=64).tolist()) for i in range(200)]
    d = spark.createDataFrame(rows, "tensor string, row long, values array<double>").repartition(5)
    path = str(tmp_path / "x")
    d.write.format("gguf").options(path=path, type=kind).mode("overwrite").save()
    back = load(spark, "gguf", path, range_bytes=700)
    assert back.rdd.getNumPartitions() > 15
    got = {(x["tensor"], x["row"]): x["values"] for x in back.collect()}
    assert set(got) == {x[:2] for x in rows}
    assert all(np.allclose(got[t, i], v, atol=near, rtol=0) for t, i, v in rows)
    assert {x["tensor"] for x in back.filter("tensor = 't1'").collect()} == {"t1"}
    reader = files.TensorReader(path, 700)
    every = len(reader.partitions())
    reader.pushFilters([files.EqualTo(("tensor",), "t1")])
    assert 0 < len(reader.partitions()) < every


def test_only_committed_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "x")
    d = spark.createDataFrame([("t", i, [float(i)]) for i in range(20)], "tensor string, row long, values array<double>")
    save = lambda mode, d: d.write.format("gguf").options(path=path, type="F64").mode(mode).save()
    save("overwrite", d)
    stray = files.gguf_bytes([("t", "F64", [1, 1], struct.pack("<d", 7.0))])
    (tmp_path / "x" / "part-lost.gguf").write_bytes(stray)  # of a task that never committed
    assert load(spark, "gguf", path).count() == 20
    save("append", d)
    assert load(spark, "gguf", path).count() == 40
    save("overwrite", d.limit(3))
    assert load(spark, "gguf", path).count() == 3
    save("overwrite", d.limit(0))
    assert load(spark, "gguf", path).count() == 0
    writer = files.TensorWriter(path, "F64", True)
    part = writer.write(iter(d.toArrow().to_batches()))
    writer.abort([part, None])
    assert not any(os.path.exists(f"{path}/{n}") for n in part.files) and load(spark, "gguf", path).count() == 0


def test_parts_have_a_bound(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(files, "PART", 50_000)
    batch = pa.RecordBatch.from_pydict({"tensor": ["t"] * 9_000, "row": list(range(9_000)), "values": [[1.0, 2.0]] * 9_000})
    part = files.TensorWriter(str(tmp_path), "F64", True).write(iter([batch]))
    assert len(part.files) > 1


def test_damaged_tensor_files_are_errors(spark, tmp_path):
    good = files.gguf_bytes([("t", "F32", [4, 2], np.arange(8, dtype="<f4").tobytes())])
    (tmp_path / "a.gguf").write_bytes(good)
    assert [x["values"] for x in load(spark, "gguf", f"file://{tmp_path}/a.gguf").orderBy("row").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    for i, bad in enumerate([b"nope", good[:-40], good[:30]]):
        (tmp_path / f"bad{i}.gguf").write_bytes(bad)
        with pytest.raises(Exception, match="magic|truncated|size"):
            load(spark, "gguf", str(tmp_path / f"bad{i}.gguf")).count()


def test_log_probs_round_trip_and_match_the_layout(spark, tmp_path):
    n_ctx, n_vocab = 8, 5
    per = n_ctx - 1 - n_ctx // 2
    r = random.Random(1)
    rows = [(c, p, 0.5, -3.25, [r.randrange(65_536) for _ in range(n_vocab)]) for c in range(40) for p in range(per)]
    d = spark.createDataFrame(rows, "chunk long, place int, scale double, low double, q array<int>")
    path = str(tmp_path / "x")
    d.repartitionByRange(3, "chunk").sortWithinPartitions("chunk", "place").write.format("logprobs").options(path=path, n_ctx=n_ctx).mode("overwrite").save()
    back = load(spark, "logprobs", path, range_bytes=100)
    assert sorted(map(tuple, back.collect())) == sorted(rows) and back.rdd.getNumPartitions() > 10
    some = back.filter("chunk >= 11 and chunk < 14")
    assert sorted(map(tuple, some.collect())) == [x for x in sorted(rows) if 11 <= x[0] < 14]
    plain = tmp_path / "one.logits"  # as another program lays it out: one chunk, record by record
    body = b"".join(struct.pack("<ff6H", 0.5, -1.0, *range(10 * i, 10 * i + 5), 0) for i in range(per))
    plain.write_bytes(b"_logits_" + struct.pack("<iii", n_ctx, n_vocab, 1) + struct.pack(f"<{n_ctx}i", *range(n_ctx)) + body)
    assert [tuple(x) for x in load(spark, "logprobs", str(plain)).orderBy("place").collect()] == [(0, i, 0.5, -1.0, list(range(10 * i, 10 * i + 5))) for i in range(per)]
    plain.write_bytes(plain.read_bytes()[:-1])
    with pytest.raises(Exception, match="truncated"):
        load(spark, "logprobs", str(plain)).count()


def test_ngram_caches_split_by_their_index(spark, tmp_path):
    r = random.Random(2)
    rows = sorted({(tuple(r.randrange(9) for _ in range(r.randrange(1, 5))), r.randrange(30)) for _ in range(3_000)})
    rows = [(list(g), t, r.randrange(1, 10**6)) for g, t in rows]
    d = spark.createDataFrame(rows, "ngram array<int>, next_token int, cnt long").repartition(3, "ngram").sortWithinPartitions("ngram")
    path = str(tmp_path / "x")
    d.write.format("ngram_cache").options(path=path, range_bytes=1_000).mode("overwrite").save()
    back = load(spark, "ngram_cache", path)
    assert back.rdd.getNumPartitions() > 10
    assert sorted((x["ngram"], x["next_token"], x["cnt"]) for x in back.collect()) == sorted((g, t, n) for g, t, n in rows)
    plain = tmp_path / "plain.bin"
    plain.write_bytes(struct.pack("<9i", 5, -1, -1, -1, 2, 7, 3, 8, 1) + struct.pack("<7i", 1, 2, 3, 4, 1, 9, 6))
    assert sorted((x["ngram"], x["next_token"], x["cnt"]) for x in load(spark, "ngram_cache", str(plain)).collect()) == [([1, 2, 3, 4], 9, 6), ([5], 7, 3), ([5], 8, 1)]
    for bad in (struct.pack("<7i", 1, 2, 3, 4, 1, 9, 0), struct.pack("<6i", 1, 2, 3, 4, 1, 9)):
        plain.write_bytes(bad)
        with pytest.raises(Exception, match="below 1|truncated"):
            load(spark, "ngram_cache", str(plain)).count()


# Streams


def table_of(d):
    return sorted(map(tuple, d.select("n", "ngram", "next_token", "cnt").collect()))


def test_stream_of_counts_survives_restarts_and_replays(spark, tmp_path):
    r = random.Random(5)
    lines = [[r.choice("abc") for _ in range(r.randrange(12))] for _ in range(60)]
    source, path, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    d = spark.createDataFrame([(x,) for x in lines], "t array<string>")
    stream = lambda: spark.readStream.schema("t array<string>").option("maxFilesPerTrigger", 1).parquet(source)
    d.limit(0).write.parquet(source)
    for i in range(3):
        spark.createDataFrame([(x,) for x in lines[20 * i : 20 * i + 20]], "t array<string>").repartition(2).write.mode("append").parquet(source)
        if i == 1:  # a batch dies behind its write: the stream plays it again
            upsert = count_tables.upsert
            try:
                def dies(counts, number, at):
                    upsert(counts, number, at)
                    raise RuntimeError("lost")

                count_tables.upsert = dies
                with pytest.raises(Exception, match="lost"):
                    count_tables.follow(stream(), "t", path, check, 2, every=2).awaitTermination()
            finally:
                count_tables.upsert = upsert
        count_tables.follow(stream(), "t", path, check, 2, every=2).awaitTermination()
        assert table_of(count_tables.read(spark, path)) == table_of(ngrams.counts(spark.read.parquet(source), "t", 2))
    want = table_of(ngrams.counts(d, "t", 2))
    last = count_tables.compact(spark, path)
    assert not count_tables.upsert(ngrams.counts(d, "t", 2), last, path)  # replayed behind its compaction
    assert table_of(count_tables.read(spark, path)) == want
    (tmp_path / "table" / "base" / f"upto={last + 5}").mkdir()  # a base whose writer was lost
    assert table_of(count_tables.read(spark, path)) == want
    both = str(tmp_path / "dynamic")
    for run in (0, 1, 1):
        count_tables.fold(spark, path, both, run)
    assert table_of(count_tables.read(spark, both)) == [(a, b, c, 2 * n) for a, b, c, n in want]
    assert count_tables.read(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize(("text", "want"), [("", ("", "", False)), ("ab", ("a", "b", False)), ("xSTO", ("x", "STO", False)), ("xSTOPy", ("x", "", True)), ("bSTOP then ban", ("b", "", True)), ("aban", ("a", "", True)), ("STOSTO", ("STO", "STO", False))])
def test_cut_holds_what_may_begin_a_stop(text, want):
    assert answers.cut(text, ["STOP", "ban"]) == want


def feed(spark, source, rows):
    spark.createDataFrame(rows, "key string, no long, piece string").coalesce(1).write.mode("append").parquet(source)


def run_answers(spark, tmp_path, **kw):
    out = answers.answers(spark.readStream.schema("key string, no long, piece string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["STOP", "</end>"], **kw)
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    return out.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check"))


def said(spark, tmp_path):
    rows = spark.read.schema("key string, part string, finished string, batch int").parquet(str(tmp_path / "out")).orderBy("batch").collect()
    return {k: ("".join(r["part"] for r in rows if r["key"] == k), [r["finished"] for r in rows if r["key"] == k and r["finished"]]) for k in {r["key"] for r in rows}}


def test_stop_strings_across_batches_and_a_restart(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [("a", 2, "ld ST"), ("a", 1, "hello wor"), ("b", 1, "no stop <"), ("c", 1, None)])
    run_answers(spark, tmp_path).trigger(availableNow=True).start().awaitTermination()
    assert said(spark, tmp_path) == {"a": ("hello world ", []), "b": ("no stop ", [])}
    feed(spark, str(tmp_path / "in"), [("a", 3, "OP and more"), ("b", 2, "/e"), ("c", 2, "x")])
    run_answers(spark, tmp_path).trigger(availableNow=True).start().awaitTermination()  # the state comes from the checkpoint
    feed(spark, str(tmp_path / "in"), [("a", 4, "late"), ("b", 3, "xit")])
    run_answers(spark, tmp_path).trigger(availableNow=True).start().awaitTermination()
    assert said(spark, tmp_path) == {"a": ("hello world ", ["stop"]), "b": ("no stop </exit", []), "c": ("x", [])}


def test_idle_answers_end_by_a_timer(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [("a", 1, "open <"), ("b", 1, "done STOP")])
    q = run_answers(spark, tmp_path, idle=500).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if os.path.exists(tmp_path / "out") and said(spark, tmp_path).get("a") == ("open <", ["idle"]):
                break
    finally:
        q.stop()
    assert said(spark, tmp_path) == {"a": ("open <", ["idle"]), "b": ("done ", ["stop"])}


# Epochs


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 3))
    y = (x @ [1.5, -2.0, 0.5] + r.normal(size=500) > 0.3).astype(float)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    odd = [(None, 1.0, 1.0, 1.0, 1.0), (900, None, 1.0, 1.0, 1.0), (901, 1.0, 1.0, 1.0, None), rows[0]]
    return spark.createDataFrame(rows + odd, "id long, a double, b double, c double, y double"), rows + [rows[0]]


def plain_fit(rows, epochs, step, percent):
    import zlib

    held = np.array([zlib.crc32(str(r[0]).encode()) % 100 < percent for r in rows])
    x, y = np.array([[1.0, *r[1:4]] for r in rows]), np.array([r[4] for r in rows])
    w, m, v, losses = np.zeros(4), np.zeros(4), np.zeros(4), []
    loss = lambda k, w: float(np.mean(np.log(1 + np.exp(x[k] @ w)) - y[k] * (x[k] @ w)))
    for t in range(1, epochs + 1):
        losses.append((t, loss(~held, w), loss(held, w)))
        g = x[~held].T @ (1 / (1 + np.exp(-x[~held] @ w)) - y[~held]) / (~held).sum()
        if step == "sgd":
            w = w - 0.1 * (g + 0.01 * w)
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - 0.1 * 0.01) - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, losses


@pytest.mark.parametrize("step", ["adamw", "sgd"])
def test_epochs_equal_numpy_and_go_on_after_a_restart(spark, labelled, tmp_path, step):
    d, rows = labelled
    w, losses = plain_fit(rows, 6, step, 20)
    run = lambda n, path: training.fit(d.repartition(7), "id", ["a", "b", "c"], "y", n, path, step=step, decay=0.01)
    once = run(6, None)
    assert np.allclose(once.w, w, atol=1e-9) and np.allclose(once.losses, losses, atol=1e-9)
    path = str(tmp_path / step)
    run(4, path)
    os.remove(f"{path}/epoch=4/_SUCCESS")  # the fourth epoch was lost while it was kept
    again = run(6, path)
    assert np.allclose(again.w, w, atol=1e-9) and np.allclose(again.losses, losses, atol=1e-9)
    p = d.filter("a is not null").withColumn("p", training.predict(d, ["a", "b", "c"], again.w)).collect()
    assert all(abs(r["p"] - 1 / (1 + math.exp(-(again.w[0] + again.w[1:] @ [r["a"], r["b"], r["c"]])))) < 1e-12 for r in p)


def test_fit_of_nothing_and_of_squares(spark, labelled):
    d, rows = labelled
    none = training.fit(d.limit(0), "id", ["a"], "y", 2)
    assert none.w.tolist() == [0.0, 0.0] and none.losses == [(1, None, None), (2, None, None)]
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    value, grad = training.squared(x, y, np.array([0.1, 0.2, 0.3, 0.4]))
    e = (0.1 + x @ [0.2, 0.3, 0.4]) - y
    assert abs(value - e @ e) < 1e-9 and np.allclose(grad, [2 * e.sum(), *(2 * e @ x)])


# Table functions


def test_samplers_of_rows_stream_each_context(spark):
    r = random.Random(4)
    rows = [("hot", i, r.gauss(0, 2)) for i in range(2_000)] + [("ties", i, 1.0) for i in range(6)] + [(None, 1, 0.0), ("one", 5, None), ("two", 3, 0.5)]
    d = spark.createDataFrame([(*x, "more") for x in r.sample(rows, len(rows))], "ctx string, id long, logit double, left string")
    got = rowwise.sample(d, ("top_k", 4), ("min_p", 0.5), ("temperature", 2.0)).collect()
    want = []
    for c in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == c and x[2] is not None), key=lambda x: (-x[2], x[1]))[:4]
        want += [(c, i, v / 2) for _, i, v in mine if v >= mine[0][2] + math.log(0.5)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))

    class EvenOnly:
        def step(self, token, logit):
            return logit if token % 2 == 0 else None

    assert {x["id"] % 2 for x in rowwise.sample(d, EvenOnly, ("top_k", 3)).collect()} == {0}
    assert rowwise.sample(d.limit(0), ("top_k", 3)).count() == 0
    with pytest.raises(Exception, match="ctx, id and logit"):
        rowwise.row_sampler(("top_k", 1))(d.select("ctx").asTable()).count()


def test_custom_op_with_a_state_and_an_end(spark):
    def step(s, row):
        s["n"] = s.get("n", 0) + row["v"]
        s["g"] = row["g"]
        yield row["g"], s["n"], False

    op = rowwise.custom_op(step, "g string, total long, last boolean", ["g"], ["at"], end=lambda s: [(s["g"], s["n"], True)])
    d = spark.createDataFrame([("a", 2, 10), ("a", 1, 5), ("b", 1, 7)], "g string, at int, v long")
    assert sorted(map(tuple, op(d.asTable()).collect())) == [("a", 5, False), ("a", 15, False), ("a", 15, True), ("b", 7, False), ("b", 7, True)]


# Templates


MESSAGES = "messages array<struct<role: string, content: string, calls: array<struct<name: string, arguments: string>>>>, n int"
TALK = ([("system", " Be kind. ", []), ("user", 'Say "hi"\n', None), ("assistant", "", [("f", '{"x": 1}'), ("g", "{}")]), ("tool", None, [])], 3)


@pytest.mark.parametrize(("source", "want"), [
    ("a {{ n }} b", "a 3 b"),
    ("{% for m in messages %}{{ loop.index }}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}", "1system,2user,3assistant,4tool"),
    ("{% for m in messages[1:] %}{{ m.role | upper }}{% endfor %}|{{ messages[-1].role }}|{{ messages[0].content | trim }}|{{ messages[9].role }}|", "USERASSISTANTTOOL|tool|Be kind.||"),
    ("{% for m in messages[:2] %}{{ m.role[0:1] if false }}{% endfor %}", ValueError),
    ("{%- if messages[0].role == 'system' -%}  {% set s = messages[0].content %}  {%- else %}{% set s = 'none' %}{% endif -%}\n [{{ s }}]", "[ Be kind. ]"),
    ("{% if n > 3 or n == 3 and not false %}yes{% elif n %}some{% else %}no{% endif %}", "yes"),
    ("{% if n < 3 %}yes{% elif 'kind' in messages[0].content %}some{% else %}no{% endif %}", "some"),
    ("{% if tools is defined %}T{% endif %}{% if tools is not defined %}U{% endif %}{% if messages[3].content is none %}N{% endif %}{{ messages[3].content | default('-') }}", "UN-"),
    ("{% for m in messages %}{% for c in m.calls %}{{ loop.index0 ~ c.name ~ c['arguments'] }};{% endfor %}{% endfor %}", '0f{"x": 1};1g{};'),
    ("{{ messages[1].content | tojson }}{{ messages | length }}{{ n + 1 }}{{ 'a' + 'b' }}{{ n == 3 }}", '"Say \\"hi\\"\\n"4' + "4abTrue"),
    ("x\n  {% if true %}\ny\n  {% endif %}\nz{# note #}", "x\ny\nz"),
    ("{{ n }}{% if n == 4 %}{{ raise_exception('bad') }}{% endif %}", "3"),
    ("{% macro x() %}{% endmacro %}", ValueError), ("{% if n %}", ValueError), ("{{ n | wordcount }}", ValueError), ("{{ n ? 1 }}", ValueError),
])
def test_templates_compile(spark, source, want):
    d = spark.createDataFrame([TALK], MESSAGES)
    if want is ValueError:
        with pytest.raises(ValueError, match=r"\w"):
            templates.compile_template(source, d.schema)
        return
    assert d.select(templates.compile_template(source, d.schema).alias("x")).collect()[0]["x"] == want


def test_tool_call_families(spark):
    d = spark.createDataFrame([TALK, ([], 0), (None, 0)], MESSAGES)
    got = {n: [r[0] for r in d.select(templates.compile_template(t, d.schema, add_generation_prompt=True, bos_token="<s>", eos_token="</s>")).collect()] for n, t in templates.FAMILIES.items()}
    assert got["hermes"][0] == '<|im_start|>system\n Be kind. <|im_end|>\n<|im_start|>user\nSay "hi"\n<|im_end|>\n<|im_start|>assistant\n\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n<|im_start|>tool\n<tool_response>\n\n</tool_response><|im_end|>\n<|im_start|>assistant\n'
    assert got["mistral"][0] == '<s>[INST]  Be kind. [/INST][INST] Say "hi"\n[/INST][TOOL_CALLS] [{"name": "f", "arguments": {"x": 1}}, {"name": "g", "arguments": {}}]</s>[TOOL_RESULTS] {"content": null}[/TOOL_RESULTS]'
    assert got["llama3"][0].startswith("<s><|start_header_id|>system<|end_header_id|>\n\nBe kind.<|eot_id|><|start_header_id|>user") and "<|start_header_id|>ipython<|end_header_id|>\n\n<|eot_id|>" in got["llama3"][0]
    assert got["hermes"][1:] == ["<|im_start|>assistant\n"] * 2


# Extraction


def test_a_killed_run_repeats_no_finished_prompt(spark, tmp_path):
    log, path = str(tmp_path / "asked"), str(tmp_path / "ledger")
    p = spark.createDataFrame([(f"e{i % 7}", i, f"prompt {i}") for i in range(90)] + [("e0", 0, "prompt 0"), ("null", 1, None)], "entity string, chunk_no long, prompt string").repartition(3)

    def make(dies_at=None):
        def start():
            n = []

            def f(text):
                n.append(1)
                if dies_at and len(n) >= dies_at:
                    os._exit(1)  # the worker is gone in the middle of its prompts
                with open(log, "a") as s:
                    s.write(text + "\n")
                if text.endswith("7") and "17" not in text:
                    raise ValueError("no answer")
                time.sleep(0.002 if "3" in text else 0)
                return text.upper()

            return f

        return start

    with pytest.raises(Exception, match="."):
        extraction.extract_resumed(p, make(15), path, in_flight=2, flush=1, tries=1).count()
    first = {r["key"] for r in extraction.ledger(p, path).collect()}
    assert 10 < len(first) < 80
    before = open(log).read().split("\n")
    got = extraction.extract_resumed(p, make(), path, in_flight=4, flush=5, tries=2).collect()
    assert first < {r["key"] for r in extraction.ledger(p, path).collect()}
    assert len(got) == 92 and sum(r["entity"] == "e0" and r["chunk_no"] == 0 for r in got) == 2
    for r in got:
        no = r["chunk_no"]
        if r["entity"] == "null":
            assert r["answer"] is None and r["error"] is None
        elif str(no).endswith("7") and no != 17:
            assert r["answer"] is None and r["error"] == "no answer"
        else:
            assert r["answer"] == f"PROMPT {no}" and r["error"] is None
    after = open(log).read().split("\n")[len(before) - 1 :]
    assert len(set(after) & set(before) - {""}) <= 3 * 3  # what was under way in the lost tasks
    assert extraction.extract_resumed(p, make(1), path).filter("error is null").count() == 92 - 8  # nothing is left to ask, so nothing dies
    changed = extraction.extract_resumed(p, lambda: lambda t: "found", path, again=True)
    assert changed.filter("error is not null").count() == 0 and changed.filter("answer = 'found'").count() == 8
    assert extraction.extract_resumed(p.limit(0), make(1), str(tmp_path / "none")).count() == 0
