"""Tokenisers against their libraries, grammars, codecs against scalar loops, samplers and recurrences against plain Python, ranges, readers."""

from __future__ import annotations

import collections
import json
import math
import random
import re
import struct

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from notewright.functions import contracts
from notewright.functions import grammar as G
from notewright.functions import kquants as K
from notewright.functions import media as M
from notewright.functions import scalars as X
from notewright.functions import tensor as T
from notewright.functions import tokenizers as Z
from notewright.operators import assembly as A
from notewright.operators import joins as J
from notewright.operators import ngrams as N
from notewright.operators import sampling as S
from notewright.operators import stats
from notewright.queries import QUERIES
from notewright.sources import tasks

DIR = "/opt/tokenizers"
SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "Hello world's end, 12345!", "  two  spaces\n\nlines\t", "naïve Äpfel 東京タワー 🤖 don't", "a" * 300, "<|endoftext|> x <|endoftext|>", "été\r\n\r\nfin…", "x  "]


def sample_texts():
    r = random.Random(3)
    return TEXTS[:6] + TEXTS[7:] + ["".join(r.choice("abcdefgh THE ing,.é☃\n 12") for _ in range(r.randrange(90))) for _ in range(200)]


def data(name):
    with open(f"{DIR}/{name}", "rb") as f:
        return f.read()


def test_byte_bpe_equals_the_library():
    import tiktoken

    ranks = Z.load_ranks(data("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=Z.GPT2, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    mine = Z.ByteBpe(ranks, special={"<|endoftext|>": 50256})
    for t in [*TEXTS, *sample_texts()]:
        ids = mine.encode(t)
        assert ids == lib.encode(t, allowed_special="all")
        assert mine.decode(ids) == t
    multi = Z.load_ranks(data("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("multi", pat_str=Z.LLAMA3, mergeable_ranks=multi, special_tokens={})
    for t in sample_texts():
        assert Z.ByteBpe(multi, Z.LLAMA3).encode(t) == lib.encode_ordinary(t)


def test_score_pieces_equal_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=f"{DIR}/piece_bpe_32k.model")
    pieces = Z.load_pieces(data("piece_bpe_32k.model"))
    assert [p for p, _, _ in pieces] == [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    mine = Z.score_pieces(pieces)
    for t in sample_texts():
        if "▁" not in t:
            ids = mine.encode(t)
            assert ids == lib.encode(t)
            assert mine.decode(ids) == t


def test_presplit_equals_the_pattern(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(sample_texts())], "i long, text string")
    for r in d.select("text", Z.presplit(F.col("text")).alias("p")).collect():
        assert r["p"] == regex.findall(Z.GPT2, r["text"])


def test_word_pieces_by_hand():
    ids = {w: i for i, w in enumerate(["un", "##able", "##ab", "##le", "want", "##ed", ",", "runn", "##ing", "eleve", "東"])}
    t = Z.WordPieces(ids, unknown=99)
    assert t.encode("UNwanted, running Élève 東xyz") == [99, 6, 7, 8, 9, 10, 99]
    assert t.encode("unable") == [0, 1]
    assert t.encode("wanted") == [4, 5]
    assert t.encode(None) == []


def test_unigram_is_the_best_path():
    scores = {"▁": -2.0, "a": -1.5, "b": -1.5, "ab": -2.5, "▁a": -2.7, "ba": -2.4, "aba": -4.0}
    t = Z.Unigram(scores, {p: i + 1 for i, p in enumerate(scores)})
    r = random.Random(7)

    def best(w):
        return 0.0 if not w else max((scores[w[:n]] if w[:n] in scores else (t.low if n == 1 else -1e9)) + best(w[n:]) for n in range(1, min(3, len(w)) + 1))

    back = {i + 1: p for i, p in enumerate(scores)}
    for _ in range(100):
        w = "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
        assert sum(scores[back[i]] for i in t.encode(w)) == pytest.approx(best("▁" + w))


def test_greedy_bytes():
    t = Z.GreedyBytes({b"a": 1, b"ab": 2, b"abc": 3, "é".encode(): 4}, unknown=0)
    assert t.encode("abcabaéz") == [3, 2, 1, 4, 0]


def test_grammar_round_trips():
    m = G.Matcher(G.parse('root ::= expr # comment\nexpr ::= term ([-+] term)*\nterm ::= [0-9]+ | "(" expr ")"\n'))
    assert m.accepts("1+(2-3)")
    assert not m.accepts("1+(")
    assert m.begins("1+(")
    assert not m.begins("1+)")
    for bad in ('root ::= root "a"\n', "root ::= other\n", 'root ::= "a" |\nx', 'a ::= b\nb ::= "x"? a\n'):
        with pytest.raises(ValueError, match="."):
            G.parse(bad)
    rules = G.parse('root ::= "Answer: " ("Yes" | "No") "\\n"? year{1,2}\nyear ::= [^a-z] [0-9]{3}\n')
    pattern = G.to_regex(rules).replace(r"\z", r"\Z")
    m = G.Matcher(rules)
    for t in ("Answer: Yes\n1999", "Answer: No1999X123", "Answer: No", "Answer: Noa123", "Answer: Maybe1999"):
        assert bool(re.match(pattern, t)) == m.accepts(t)


@pytest.mark.parametrize(("low", "high"), [(0, 9), (5, 120), (17, 4321), (100, 100), (0, 0), (-30, 12), (-40, -3), (999, 1001)])
def test_integer_ranges(low, high):
    m = G.Matcher(G.parse(f"root ::= {G.integers(low, high)}\n"))
    assert all(m.accepts(str(x)) == (low <= x <= high) for x in range(-500, 5000))


SCHEMA = {
    "type": "object", "required": ["a"], "$defs": {"t": {"type": "string", "minLength": 2}},
    "properties": {"a": {"type": "integer", "minimum": -5, "maximum": 120}, "b": {"type": "array", "items": {"enum": ["x", "y"]}, "minItems": 1, "maxItems": 2}, "c": {"$ref": "#/$defs/t"}, "d": {"oneOf": [{"const": 1}, {"type": "null"}]}},
    "additionalProperties": False,
}


@pytest.mark.parametrize(("text", "ok"), [
    ('{"a": 7}', True), ('{"a": 121}', False), ('{"a":-5, "b": ["x","y"], "c":"hey"}', True), ('{"a":1,"c":"h"}', False), ('{"b":["x"]}', False), ('{"a":120,"b":[]}', False),
    ('{"a":1,"b":["x","x","x"]}', False), ('{"a":1,"d":null}', True), ('{"a":1,"d":2}', False), ('{"a":1,"z":2}', False), ("[]", False),
])
def test_schemas_agree(text, ok):
    assert G.Matcher(G.parse(G.schema_grammar(SCHEMA))).accepts(text) == ok


CHECKS = [
    (SCHEMA, [('{"a": 7}', True), ('{"a": 121}', False), ('{"a":-5, "b": ["x","y"], "c":"hey"}', True), ('{"a":1,"c":"h"}', False), ('{"b":["x"]}', False), ('{"a":120,"b":[]}', False), ('{"a":1,"b":["x","z"]}', False),
              ('{"a":1,"d":null}', True), ('{"a":1,"d":2}', False), ('{"a":1,"z":2}', False), ("[]", False), ("{", False), (None, False), ('{"a":1.0}', True), ('{"a":1.5}', False), ('{"a":"1"}', False)]),
    ({"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}, [("3", True), ("7", False), ("7.5", True), ("2.5", False), ('"x"', False)]),
    ({"allOf": [{"properties": {"a": {"type": "string"}}}, {"required": ["a"]}]}, [('{"a":"x"}', True), ('{"a":1}', False), ("{}", False), ("5", True), ('{"a":null}', False)]),
    ({"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": {"type": "integer"}}, [('[1,"x",2]', True), ('[1,"x","y"]', False), ("[1]", True), ('["x"]', False), ("{}", True), ("[]", True)]),
    ({"type": "array", "items": {"type": "array", "items": {"type": "object", "properties": {"k": {"enum": [1, "one", None, [1, 2]]}}, "required": ["k"]}}}, [('[[{"k":1}],[{"k":"one"},{"k":null}]]', True), ('[[{"k":1.0}]]', True), ('[[{"k":2}]]', False), ('[[{}]]', False), ("[[1]]", False), ("[[]]", True), ('[[{"k":[1,2]}]]', True)]),
    ({"type": "object", "additionalProperties": {"type": ["string", "null"], "pattern": "^x", "maxLength": 3}, "properties": {"n": {"not": {"type": "boolean"}}}}, [('{"q":"xy","n":1}', True), ('{"q":"yx"}', False), ('{"q":null}', True), ('{"q":"xxxx"}', False), ('{"n":true}', False), ("{}", True)]),
    ({"anyOf": [{"const": True}, {"type": "number", "exclusiveMinimum": 0, "multipleOf": 0.5}, {"const": {"b": 1, "a": [2]}}]}, [("true", True), ("false", False), ("1.5", True), ("0", False), ("1.2", False), ('{"a":[2],"b":1}', True), ('{"a":[2]}', False)]),
    (True, [("1", True), ("nope", False), ("null", True)]), (False, [("1", False)]), ({}, [('{"any": 1}', True)]),
]


@pytest.mark.parametrize("no", range(len(CHECKS)))
def test_schemas_are_checked_natively(spark, no):
    schema, cases = CHECKS[no]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["ok"] for r in d.select("i", contracts.schema_to_checks(schema, F.col("t")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]


def test_recursive_schemas_are_refused():
    s = {"$defs": {"t": {"properties": {"next": {"$ref": "#/$defs/t"}}}}, "$ref": "#/$defs/t"}
    with pytest.raises(ValueError, match="recursive"):
        contracts.schema_to_checks(s, F.col("t"))


def test_types_of_tensors_keep_repeated_rows(spark, monkeypatch):
    from notewright.functions import kquants

    t = spark.createDataFrame([("blk.0.attn", 1), ("blk.0.attn", 1), ("out", 2), (None, 3)], "name string, n int")
    rules = spark.createDataFrame([(2, "attn", "q6"), (1, "^blk", "q5"), (3, "^out$", "f16")], "priority int, pattern string, type string")
    for few in (1_000, 0):
        monkeypatch.setattr(kquants, "FEW_RULES", few)
        got = sorted(((r["name"], r["n"], r["type"]) for r in kquants.choose_types(t, rules, "q4").collect()), key=str)
        assert got == [("blk.0.attn", 1, "q5"), ("blk.0.attn", 1, "q5"), ("out", 2, "f16"), (None, 3, "q4")]


def test_healing_every_cut():
    whole = json.dumps({"a": [1, 2.5, {"b": 'x\\"yé\n'}], "c": None, "d": True, "e": -1e5, "": {}})
    for i in range(1, len(whole) + 1):
        got = json.loads(G.heal(whole[:i]))
        assert isinstance(got, dict)
        assert set(got) <= {"a", "c", "d", "e", ""}
    assert G.heal(whole) == whole
    assert [G.heal(t) for t in ('{"a": 1, "b', '{"a": tr', "[1, 2", "}", '{"a"', "", "tru", "{]")] == ['{"a": 1}', '{"a": null}', "[1, null]", None, '{"a": null}', "null", "null", None]
    assert json.loads(G.heal('{"k": "half', "<cut>")) == {"k": "half<cut>"}


def test_partial_patterns():
    assert G.partial_match("abc+d", "xxabcc") == (2, 6)
    assert G.partial_match("a(b|c)d", "zzac") == (2, 4)
    assert G.partial_match("abc", "ab") == (0, 2)
    assert G.partial_match("abc", "xyz") is None
    assert G.partial_match("a[0-9]{2,3}b", "..a12") == (2, 5)
    assert G.partial_match("ab", "xaby") == (1, 3)


def loop(kind, b):
    """A block decoded value by value."""
    half = lambda o: float(np.frombuffer(bytes(b[o : o + 2]), dtype=np.float16)[0])
    y = [0.0] * 256
    for n in range(256):
        side, rest = divmod(n, 128)
        if kind in ("q4_k", "q5_k"):
            j, at = divmod(n, 32)
            s = b[4:16]
            scale, low = (s[j] & 63, s[j + 4] & 63) if j < 4 else ((s[j + 4] & 15) | ((s[j - 4] >> 6) << 4), (s[j + 4] >> 4) | ((s[j] >> 6) << 4))
            q = b[(16 if kind == "q4_k" else 48) + (j // 2) * 32 + at]
            q = (q & 15 if j % 2 == 0 else q >> 4) + (16 if kind == "q5_k" and b[16 + at] >> j & 1 else 0)
            y[n] = half(0) * scale * q - half(2) * low
        elif kind == "q2_k":
            q = b[16 + side * 32 + rest % 32] >> 2 * (rest // 32) & 3
            y[n] = half(80) * (b[n // 16] & 15) * q - half(82) * (b[n // 16] >> 4)
        elif kind == "q3_k":
            j, s = n // 16, b[96:108]
            scale = ((s[j] & 15) if j < 8 else s[j - 8] >> 4) | (s[8 + j % 4] >> 2 * (j // 4) & 3) << 4
            q = (b[32 + side * 32 + rest % 32] >> 2 * (rest // 32) & 3) - (0 if b[rest % 32] >> side * 4 + rest // 32 & 1 else 4)
            y[n] = half(108) * (scale - 32) * q
        else:
            k, at = divmod(rest, 32)
            low = b[side * 64 + at + 32 * (k % 2)]
            q = (low & 15 if k < 2 else low >> 4) | (b[128 + side * 32 + at] >> 2 * k & 3) << 4
            scale = b[192 + side * 8 + k * 2 + at // 16]
            y[n] = half(208) * (scale - 256 if scale > 127 else scale) * (q - 32)
    return np.array(y)


@pytest.mark.parametrize(("kind", "halves"), [("q2_k", (80, 82)), ("q3_k", (108,)), ("q4_k", (0, 2)), ("q5_k", (0, 2)), ("q6_k", (208,))])
def test_super_blocks_by_loops(kind, halves):
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, (3, K.CODECS[kind][0]), dtype=np.uint8)
    for o in halves:
        raw[:, o : o + 2] = r.normal(0, 1, (3, 1)).astype(np.float16).view(np.uint8)
    got = K.decode_bytes(raw.tobytes(), kind).reshape(3, 256)
    for i in range(3):
        assert np.allclose(got[i], loop(kind, [int(x) for x in raw[i]]), rtol=1e-4, atol=1e-4)
    assert K.decode_bytes(raw.tobytes()[:-1], kind) is None


@pytest.mark.parametrize("kind", ["tq1_0", "tq2_0"])
def test_ternary_round_trip(spark, kind):
    x = np.random.default_rng(2).normal(0, 1, (2, 256)).astype(np.float32)
    d = np.abs(x).max(1, keepdims=True)
    want = np.clip(np.rint(x / d), -1, 1) * d.astype(np.float16).astype(np.float32)
    table = spark.createDataFrame([(0, x.reshape(-1).astype(float).tolist()), (1, None), (2, [])], "i long, a array<double>")
    got = {r["i"]: r["v"] for r in K.decode(K.encode(table, "a", kind, ["i"]), "blocks", kind, ["i"]).collect()}
    assert np.allclose(got[0], want.reshape(-1))
    assert got[1] is None
    assert got[2] == []


def test_bfloat16():
    x = np.array([1.0, -2.5, 3.14159, 1e-40, float("inf"), float("nan"), 65504.0], dtype=np.float32)
    y = K.bf16_decode(K.bf16_encode(x))
    assert np.isnan(y[5])
    assert np.allclose(y[[0, 1, 2, 6]], x[[0, 1, 2, 6]], rtol=1 / 256)
    assert K.bf16_encode(np.array([1.00390625], dtype=np.float32))[0] == 0x3F80  # a tie goes to the even neighbour


def test_infill_by_hand():
    assert A.fill_in([(1, "a", 0.5, False), (2, "", 0.4, True), (3, "b", 0.1, False)]) == [(2, 1.0)]
    got = A.fill_in([(1, "ab", 0.5, False), (2, "a", 0.3, False), (3, "c", 0.195, False), (4, "", 0.005, True)])
    assert [i for i, _ in got] == [1, 4]
    assert got[0][1] == pytest.approx(0.8 / 0.805)


def test_default_chain(spark):
    c = spark.createDataFrame([("c", i, x) for i, x in enumerate([5.0, 1.0, 0.5, -3.0])], "ctx string, id long, logit double")
    out = S.chain(c, *A.assemble(A.SamplerParams(top_k=1)))
    assert [r["id"] for r in out.collect()] == [0]
    with pytest.raises(ValueError, match="unknown"):
        A.assemble(A.SamplerParams(samplers=("nope",)))


def rows_of(name, spark):
    return QUERIES[name](spark, SF).collect()


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_dry_values(spark):
    """Against every suffix of every history, tried one by one."""
    by = collections.defaultdict(list)
    for r in sorted(events(spark).select("user_id", "event_id", (F.crc32("event_type") % 97).alias("t")).collect(), key=lambda r: r["event_id"]):
        by[r["user_id"]].append(r["t"])
    want = {}
    for u, t in by.items():
        best = {}
        for end in range(len(t) - 1):
            n = 0
            while n <= end and n < len(t) - 1 and t[end - n] == t[len(t) - 1 - n]:
                n += 1
            if n:
                best[t[end + 1]] = max(n, best.get(t[end + 1], 0))
        for x in set(t):
            want[u, x] = round(-(1.1 ** (best[x] - 2)), 6) if best.get(x, 0) >= 2 else 0.0
    assert {(r["ctx"], r["id"]): r["logit"] for r in rows_of("sampler_dry", spark)} == pytest.approx(want, abs=2e-6)


def _steps(spark):
    by = collections.defaultdict(list)
    for r in events(spark).select("user_id", "event_id", "value").collect():
        by[r["user_id"], r["event_id"] % 5].append((r["value"] / 100, r["event_id"]))
    return {k: sorted(v, key=lambda x: (-x[0], x[1])) for k, v in by.items()}


def _draw(probs, seed, ctx, step):
    import hashlib

    u = int(hashlib.md5(f"{seed}|{ctx}|{step}".encode()).hexdigest()[:8], 16) / 2**32
    run = 0.0
    for i, p in enumerate(probs):
        run += p
        if run > u:
            return i
    return len(probs) - 1


@pytest.mark.parametrize("version", [1, 2])
def test_mirostat_values(spark, version):
    steps, want = _steps(spark), {}
    for ctx in {k[0] for k in steps}:
        mu = 6.0
        for step in sorted(s for c, s in steps if c == ctx):
            cand = steps[ctx, step]
            z = [math.exp(x - cand[0][0]) for x, _ in cand]
            p = [x / sum(z) for x in z]
            if version == 2:
                keep = max(1, sum(-math.log2(x) <= mu for x in p))
            else:
                pairs = [(math.log((i + 2) / (i + 1)), math.log(p[i] / p[i + 1])) for i in range(min(100, len(p)) - 1)]
                s = sum(t * b for t, b in pairs) / (sum(t * t for t, _ in pairs) or 1.0)
                k = (((s - 1) * 2**mu) / (1 - 32_000 ** -(s - 1))) ** (1 / s) if s > 0 and abs(s - 1) > 1e-12 else len(p)
                keep = max(1, min(len(p), int(k)))
            q = [x / sum(p[:keep]) for x in p[:keep]]
            at = _draw(q, "mirostat", ctx, step)
            mu -= 0.1 * (-math.log2(q[at]) - 3.0)
            want[ctx, step] = (cand[at][1], mu)
    got = {(r["ctx"], r["step"]): (r["id"], r["mu"]) for r in rows_of("sampler_mirostat" if version == 1 else "sampler_mirostat_v2", spark)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=1e-5)


def test_pca_values(spark):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], dtype=float)
    v = np.linalg.eigh(x.T @ x)[1][:, -1]
    v *= 1 if v[np.abs(v).argmax()] > 0 else -1
    got = np.array([r["v"] for r in sorted(rows_of("pca_first_component", spark), key=lambda r: r["idx"])])
    gram = x.T @ x
    assert got @ gram @ got >= 0.98 * (v @ gram @ v)  # the iteration is cut; near-equal leading values mix
    assert np.allclose(np.linalg.norm(got), 1, atol=1e-3)


def test_draft_acceptance_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_drafted"], r["n_accepted"]) for r in rows_of("draft_acceptance", spark)}
    for r in docs[:60]:
        t = re.findall(r"[A-Za-z0-9_]+", r["text"])
        seen, i, drafted, right = {}, 2, 0, 0
        while i < len(t):
            guess, ctx = [], tuple(t[i - 2 : i])
            while len(guess) < 4 and ctx in seen:
                guess.append(seen[ctx])
                ctx = (ctx[1], guess[-1])
            ok = 0
            for g in guess:
                if i + ok >= len(t) or g != t[i + ok]:
                    break
                ok += 1
            drafted, right = drafted + len(guess), right + ok
            for j in range(i, min(i + ok + 1, len(t))):
                seen[t[j - 2], t[j - 1]] = t[j]
            i += ok + 1
        assert got[r["doc_id"]] == (drafted, right)


def test_recurrences_values(spark):
    by = collections.defaultdict(list)
    for r in sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"]):
        by[r["label"]].append((r["vec_id"], [float(x) for x in r["embedding"]]))
    got = {(r["op"], r["seq"], r["pos"], r["idx"]): r["v"] for r in rows_of("recurrences", spark)}
    n = range(8)
    for label, seq in by.items():
        gla, w6, w7, ssm = ([[0.0] * 8 for _ in n] for _ in range(4))
        for pos, e in seq:
            r, k, v, w, q, g, a, b = (e[8 * i : 8 * i + 8] for i in range(8))
            out6 = [sum(r[i] * (0.5 * k[i] * v[j] + w6[i][j]) for i in n) for j in n]
            w6 = [[w6[i][j] * w[i] + k[i] * v[j] for j in n] for i in n]
            gla = [[gla[i][j] * g[i] + k[i] * v[j] for j in n] for i in n]
            outg = [0.5 * sum(q[i] * gla[i][j] for i in n) for j in n]
            sa = [sum(w7[i][j] * a[j] for j in n) for i in n]
            w7 = [[w7[i][j] * w[j] + v[i] * k[j] + sa[i] * b[j] for j in n] for i in n]
            out7 = [sum(w7[i][j] * r[j] for j in n) for i in n]
            soft = [math.log1p(math.exp(x)) for x in k]
            ssm = [[ssm[i][j] * math.exp(-soft[i]) + v[j] * r[i] * soft[i] for j in n] for i in n]
            outs = [sum(ssm[i][j] * w[j] for j in n) for i in n]
            for op, out in (("wkv6", out6), ("gla", outg), ("wkv7", out7), ("ssm", outs)):
                for i in n:
                    assert got[op, label, pos, i] == pytest.approx(out[i], abs=2e-6)


def test_ordinals_of_wide_rows(spark):
    n = 1_500_000
    d = spark.range(n).select(F.xxhash64("id").alias("k"), F.md5(F.col("id").cast("string")).alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("q"))
    got = J.with_ordinal(d, ["k"]).agg(F.countDistinct("n").alias("c"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert (got["c"], got["a"], got["b"]) == (n, 1, n)


def test_running_sums_and_neighbours(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.randrange(10)) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, i long, x long")
    got = {(g["k"], g["i"]): g["s"] for g in J.running(d, ["k"], ["i"], {"s": F.col("x")}).collect()}
    near = {(g["k"], g["i"]): (g["prev_i"], g["next_i"]) for g in J.with_neighbours(d, ["k"], ["i"], ["i"]).collect()}
    for k in ("a", "b", None):
        mine, total = [x for x in rows if x[0] == k], 0
        for at, (_, i, x) in enumerate(mine):
            total += x
            assert got[k, i] == total
            assert near[k, i] == (mine[at - 1][1] if at else None, mine[at + 1][1] if at + 1 < len(mine) else None)
    assert J.running(d.limit(0), ["k"], ["i"], {"s": F.col("x")}).count() == 0


def test_ngram_grams_of_short_texts(spark):
    d = spark.createDataFrame([(["a", "b", "a", "b"],), (["x"],), ([],), (None,)], "t array<string>")
    got = {(r["n"], r["ngram"], r["next_token"]): r["cnt"] for r in N.counts(d, "t", 3).collect()}
    assert got == {(1, "a", "b"): 2, (1, "b", "a"): 1, (2, "a b", "a"): 1, (2, "b a", "b"): 1, (3, "a b a", "b"): 1}
    best = {(r["n"], r["ngram"]): r["next_token"] for r in N.best_next(N.counts(d, "t", 1)).collect()}
    assert best == {(1, "a"): "b", (1, "b"): "a"}


def test_multiple_choice_file(spark, tmp_path):
    text = lambda s: struct.pack("<I", len(s)) + s
    one = text(b"Why?") + struct.pack("<I", 2) + text(b"so") + text(b"no") + struct.pack("<2i", 1, 0) + struct.pack("<I", 0)
    (tmp_path / "t.bin").write_bytes(struct.pack("<2I", 1, 0) + one)
    (tmp_path / "bad.bin").write_bytes(struct.pack("<2I", 1, 0) + one[:9])
    got = tasks.read_multiple_choice(spark, f"file://{tmp_path}").collect()
    assert [(r["question"], r["which"], r["no"], r["answer"], r["label"]) for r in got] == [("Why?", 1, 0, "so", 1), ("Why?", 1, 1, "no", 0)]


def test_log_probs_round_trip(spark):
    d = spark.createDataFrame([([1.0, 2.0, -30.0, 0.5],), ([1.0, 1.0],)], "a array<double>")
    q = d.select("a", tasks.quantise_log_probs(F.col("a")).alias("q"))
    for r in q.select("a", tasks.log_probs(F.col("q")).alias("p")).collect():
        a = np.array(r["a"])
        want = np.maximum(a, a.max() - 16) - a.max() - np.log(np.exp(a - a.max()).sum())
        assert np.allclose(r["p"], want, atol=2e-4)


def test_media():
    img = np.arange(48, dtype=float).reshape(4, 4, 3)
    assert np.allclose(M.resize_bilinear(img, 4, 4), img)
    assert np.allclose(M.resize_bilinear(img, 2, 2)[1, 1], img[3, 3])
    assert M.pad_square(img[:2], (1, 2, 3)).shape == (4, 4, 3)
    assert M.patches(img, 2).shape == (4, 12)
    assert np.allclose(M.normalise(np.full((1, 1, 3), 255.0), (0.5,) * 3, (0.5,) * 3), 1)
    assert M.fit_size(1000, 500, 336, 14) == (336, 168)
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    mel = M.log_mel(tone, M.mel_filters(80, 400, 16_000))
    edges = M.mel_filters(80, 400, 16_000)
    assert mel.shape == (80, 101)
    assert abs((edges[mel[:, 50].argmax()] * np.arange(201) * 40).sum() / edges[mel[:, 50].argmax()].sum() - 1000) < 80
    frames = np.lib.stride_tricks.sliding_window_view(tone[:4000], 400)[::100]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    assert np.allclose(M.inverse_frames(frames * window, 100)[400:3000], tone[400:3000])


def test_scalars(spark):
    def fnv(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "foobar", "é🤖x" * 5]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fnv1a(F.col("t")).alias("f"), X.nfd(F.col("t")).alias("n"))
    for r in d.collect():
        assert r["f"] == fnv(r["t"])
    names = {"a.txt": True, "a/b": False, "": False, "..": False, "a.": False, " a": False, "x" * 256: False, "é": True, "a:b": False}
    got = {r["n"]: r["ok"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.valid_filename(F.col("n")).alias("ok")).collect()}
    assert got == names
    words = {0: "zero", 13: "thirteen", 40: "forty", 105: "one hundred five", 1_000_000: "one million", 21_999: "twenty-one thousand nine hundred ninety-nine"}
    got = {r["n"]: r["w"] for r in spark.createDataFrame([(n,) for n in words], "n long").select("n", X.number_words(F.col("n")).alias("w")).collect()}
    assert got == words
    assert not spark.createDataFrame([(b"\xff\xfe",)], "b binary").select(X.valid_utf8(F.col("b")).alias("ok")).first()["ok"]


def test_gram_takes_whole_rows_only(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],), (None,), ([1.0],), ([0.0, 1.0],)], "a array<double>")
    assert {(r["i"], r["j"]): r["v"] for r in T.gram(d, "a", 2).collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 5.0}


def test_wilson_and_power_iteration(spark):
    m = spark.createDataFrame([(i, j, float([[4, 1], [1, 3]][i][j])) for i in range(2) for j in range(2)], "i int, j int, v double")
    v = stats.power_iteration(m, 2)
    assert np.allclose(np.abs(v), np.abs(np.linalg.eigh([[4, 1], [1, 3]])[1][:, -1]), atol=1e-6)


def gguf_file(tmp_path):
    from notewright.sources import gguf

    x = np.arange(8, dtype=np.float32)
    gguf.write(str(tmp_path / "a.gguf"), [("general.name", 8, "one"), ("n", 4, 7)], [("t1", 0, [8], x.tobytes()), ("t2", 1, [4], np.arange(4, dtype=np.float16).tobytes())])
    return gguf, (tmp_path / "a.gguf").read_bytes(), x


def test_gguf_tools(spark, tmp_path):
    import hashlib

    gguf, b, x = gguf_file(tmp_path)
    again = gguf.rewrite(b, {"general.name": (8, "two"), "new": (5, -3)}, frozenset({"n"}))
    kv = {r[2]: json.loads(r[4]) for r in gguf.parse("", again) if r[1] == "kv"}
    assert kv == {"general.name": "two", "new": -3}
    assert again[-64:-32] == x.tobytes()
    with pytest.raises(ValueError, match="uint32"):
        gguf.rewrite(b, {"n": (8, "x")})
    swapped = gguf.rewrite(b, big_endian=True)
    assert swapped[4:8] == struct.pack(">I", 3)
    assert swapped[-64:-32] == x.byteswap().tobytes()
    heads = gguf.read_headers(spark, f"file://{tmp_path}/*.gguf", first=16).collect()
    assert sorted((r["kind"], r["name"]) for r in heads) == [("kv", "general.name"), ("kv", "n"), ("tensor", "t1"), ("tensor", "t2")]
    ids = {r["name"]: r["sha1"] for r in gguf.content_ids(spark, f"file://{tmp_path}").collect()}
    assert ids["t1"] == hashlib.sha1(x.tobytes()).hexdigest()
    gguf.write(str(tmp_path / "b.gguf"), [("split.no", 4, 1)], [("t3", 24, [3], b"abc")])
    merged = gguf.parse("", gguf.merge_shards([b, (tmp_path / "b.gguf").read_bytes()]))
    assert [(r[2], r[6]) for r in merged if r[1] == "tensor"] == [("t1", 0), ("t2", 32), ("t3", 64)]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    from notewright.sources import notes

    with sqlite3.connect(tmp_path / "b.sqlite") as c:
        c.execute("CREATE TABLE test (build_commit TEXT, test_time TEXT, avg_ts REAL, n_gen INTEGER)")
        c.executemany("INSERT INTO test VALUES (?, ?, ?, ?)", [("abc", "2024", 1.5, 3), ("def", None, 2.5, None)])
    got = notes.read_bench(spark, f"file://{tmp_path}/b.sqlite").orderBy("build_commit").collect()
    assert [(r["build_commit"], r["avg_ts"], r["n_gen"]) for r in got] == [("abc", 1.5, 3), ("def", 2.5, None)]


def test_messages():
    from notewright.functions.messages import parse_message

    assert parse_message("plain text") == (None, "plain text", [])
    assert parse_message('<think>why</think>\nSo: <tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call>') == ("why", "So:", [("f", '{"a": 1}')])
    assert parse_message('<function=g>{"b": [2]}</function> bye') == (None, "bye", [("g", '{"b": [2]}')])
    assert parse_message('{"tool_calls": [{"name": "f", "arguments": {}}, {"x": 1}]}') == (None, "", [("f", "{}")])
    assert parse_message("<tool_call>no json</tool_call>") == (None, "<tool_call>no json</tool_call>", [])
    assert parse_message("<think>half", partial=True) == ("half", "", [])
    assert parse_message('x <tool_call>{"name": "f", "arguments": {"a": "lo', partial=True) == (None, "x", [("f", '{"a": "lo"}')])
    assert parse_message("x <tool_c", partial=True) == (None, "x ", [])


def test_kept_tables_and_run_log(spark, tmp_path):
    from notewright.sources import caches

    t = spark.createDataFrame([(1, "a", "b", 2), (2, "a b", "c", 1)], "n int, ngram string, next_token string, cnt long")
    caches.save_counts(t, f"file://{tmp_path}/g")
    both = caches.load_counts(spark, f"file://{tmp_path}/g", f"file://{tmp_path}/g")
    assert {(r["n"], r["ngram"], r["next_token"]): r["cnt"] for r in both.collect()} == {(1, "a", "b"): 4, (2, "a b", "c"): 2}
    caches.save_counts(t.withColumn("cnt", F.lit(0).cast("long")), f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="below 1"):
        caches.load_counts(spark, f"file://{tmp_path}/bad").collect()
    m = spark.createDataFrame([("w", 0, 2.0, 3)], "name string, idx int, sum_sq double, n long")
    caches.save_activity(m, f"file://{tmp_path}/m")
    assert caches.load_activity(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/m").first()["sum_sq"] == 4.0
    d = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "i long, text string")
    assert caches.write_run(d, "text", f"file://{tmp_path}/out", {"limit": 20}, f"file://{tmp_path}/log") == {"rows": 3, "characters": 3, "empty": 2}
    log = {r["name"]: r["value"] for r in spark.read.parquet(f"file://{tmp_path}/log").collect()}
    assert log == {"limit": "20", "observed.rows": "3", "observed.characters": "3", "observed.empty": "2"}


def test_block_codec_with_sums(spark):
    from notewright.functions import codecs

    x = [float(i - 15) for i in range(32)]
    b = spark.createDataFrame([(x,)], "a array<double>").select(codecs.q8_1(F.col("a")).alias("b")).first()["b"][0]
    assert b["d"] == pytest.approx(16 / 127)
    assert b["s"] == pytest.approx(b["d"] * sum(b["qs"]))
