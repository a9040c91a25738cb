"""The operators' SQL on the smallest tables, whole operators against brute force, and ids beside nulls, long texts, clashing columns, empty tables."""

from __future__ import annotations

import collections
import math
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import ann, chat, jaccard, langid, mixing, quality, secrets, sentspans, spiece, toxicity
from notewright.llm import queries as Q

SF = "/root/testdata/sf0.001"
BIG = [2**53 + 1, 2**60 + 7, -(2**62) - 3]


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_operator_equals_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = c.sql(Q.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    mine = sorted(repr([plain(r[x]) for x in sorted(got.columns)]) for r in got.collect())
    at = [want.columns.index(x) for x in sorted(want.columns)]
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def repeats(rows, min_words):
    """doc -> pieces that go: every run of two or more pieces of enough words, all of them compared."""
    first, cover = {}, collections.defaultdict(set)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        _, keys, counts = sentspans.sentences(rows[i][1], 25, False)
        full = [j for j, n in enumerate(counts) if n]
        for a in range(len(full)):
            for b in range(a + 1, len(full)):
                if sum(counts[j] for j in full[a : b + 1]) < min_words:
                    continue
                run = " ".join(keys[j] for j in full[a : b + 1])
                run = " ".join(run.split())
                place = (rows[i][0], full[a])
                if first.setdefault(run, place) < place:
                    cover[i] |= set(range(full[a], full[b] + 1))
    return {i: sum(1 for j in s if sentspans.sentences(rows[i][1], 25, False)[2][j]) for i, s in cover.items()}


@pytest.mark.parametrize("min_words", [25, 0])
def test_span_dedup_by_brute_force(spark, min_words):
    r = random.Random(21)
    say = lambda n: " ".join(r.choice("abcdefghij") + r.choice("klmno") + r.choice(["", "", "", ".", ".\n", "!"]) for _ in range(n))
    shared = [say(n) for n in (6, 18, 30, 44, 70)]
    rows = [(i, " ".join([say(r.randrange(20)), r.choice(shared), say(r.randrange(12)), r.choice(shared)])) for i in range(30)]
    rows += [(BIG[0] + i, f"{say(3)}. {shared[3]} {shared[4]}") for i in range(3)]
    got = {x["doc_id"]: x["n_removed"] for x in sentspans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words).collect()}
    want = repeats(rows, min_words)
    assert got == {d: want.get(i, 0) for i, (d, _) in enumerate(rows)}


def test_spans_of_rows_without_id(spark):
    passage = "One two three four five six seven eight nine ten eleven twelve. Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
    rows = [(None, f"Here it starts. {passage} One end."), (None, f"Another beginning. {passage} Another end."), (None, "Nothing repeats in this one. It stays. All of it stays as it was."), (7, f"Seven begins. {passage}"), (7, "The same id with another text. It stays too. Nothing here repeats at all."), (BIG[1], passage)]
    d = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, did string")
    got = sorted((x["n_removed"], x["text"]) for x in sentspans.dedup_spans(d).collect() if x["doc_id"] is None)
    assert got[0] == (0, rows[2][1])
    assert [n > 0 for n, _ in got[1:]] == [True, True]
    by = {(x["doc_id"], x["n_removed"] > 0) for x in sentspans.dedup_spans(d).collect() if x["doc_id"] is not None}
    assert by == {(7, False), (BIG[1], True)}


def test_ids_beside_nulls_stay(spark):
    rows = [(b, "some words of text here") for b in BIG] + [(None, "you idiot"), (None, None)]
    d = spark.createDataFrame([(*x, "en", "s", "clash", "clash") for x in rows], "doc_id long, text string, lang string, source string, score string, x string")
    labels = spark.createDataFrame([(BIG[0], 1), (BIG[1], 0), (None, 1), (BIG[0], None)], "doc_id long, toxic int")
    want = sorted(map(str, [*BIG, None, None]))
    ids = lambda out, c="doc_id": sorted(str(r[c]) for r in out.collect())
    assert ids(toxicity.score(d, labels)) == want
    assert ids(sentspans.dedup_spans(d)) == want
    assert ids(langid.identify_documents(d)) == want
    assert ids(spiece.encode(d)) == want
    assert ids(secrets.scan(d)) == want
    assert ids(mixing.mix(d)) == want
    assert ids(quality.quality(d)) == want
    pages = spark.createDataFrame([(BIG[0], "http://a.b.c/", "<html lang=en>x</html>"), (None, None, None)], "page_id long, url string, html string")
    assert ids(langid.identify_pages(pages), "page_id") == sorted(map(str, [BIG[0], None]))


def test_taken_words_by_brute_force(spark):
    """Blocks taken as the plan says, word by word, and the same words in the mix itself."""
    r = random.Random(22)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(r.choice([0, 1, 5, 40, 200]))), r.choice(["a", "b", None]), 0) for i in range(40)]
    rows += [rows[3], rows[3], (41, rows[4][1], "a", 0), (41, rows[4][1], "b", 0), (None, "n o p q", "b", 0), (42, None, "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kw = {"block": 7, "shard_docs": 10}
    docs, shards = mixing.plan(d, **kw)
    plan = {(s["s_source"], s["s_shard"]): s for s in shards.collect()}
    lots = collections.defaultdict(list)
    for x in docs.collect():
        lots[x["source"], x["shard"]].append(x)
    want = collections.Counter()
    for key, mine in lots.items():
        s, at = plan[key], 0
        for x in sorted(mine, key=lambda x: (x["h"], (x["doc_id"] is not None, x["doc_id"] or 0), x["size"], x["t"])):
            taken = 0
            for _ in range(x["size"]):
                k = at // s["block"]
                taken += s["every"] + ((k * s["pa"] + s["pb"]) % s["n_blocks"] < s["extra"])
                at += 1
            want[x["doc_id"], x["source"], x["size"], taken] += 1
    got = collections.Counter((x["doc_id"], x["source"], x["size"], sum(b["words"] * b["times"] for b in x["blocks"])) for x in mixing.mix_blocks(d, **kw).collect())
    assert got == want
    words = collections.Counter()
    for x in mixing.mixed_documents(d, **kw).collect():
        words[x["doc_id"], x["source"]] += len(x["text"].split())
        assert x["n_chars"] == len(x["text"])
    total = collections.Counter()
    for (doc, source, _, taken), n in want.items():
        total[doc, source] += taken * n
    assert words == +total


def test_every_source_comes_near_its_target():
    r = random.Random(23)
    for _ in range(50):
        sizes = [r.choice([0, 3, 50, 1_000, 40_000, 5_000_000]) for _ in range(r.randrange(1, 9))]
        goal = mixing.targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))])
        lengths = mixing.block_lengths(goal, 4096)
        got = mixing.seats(goal, lengths, [[s] for s in sizes], 2)
        for g, b, (q,) in zip(goal, lengths, got, strict=True):
            assert abs(q * b - g) <= 0.011 * g + 1.5 * b if b > 1 else abs(q - g) <= 2


def test_language_evidence_by_brute_force(spark):
    """All four kinds of evidence added up in plain Python."""
    r = random.Random(24)
    vocab = {"en": "the and this river stone".split(), "fr": "les des une rivière pierre".split()}
    rows = []
    for i in range(40):
        lang = r.choice(["en", "fr"])
        rows.append((i, r.choice([lang, lang, lang, None]), r.choice(["x", None, lang]), r.choice(["d1", "d2"]), f"h{r.randrange(4)}", " ".join(r.choice(vocab[lang]) for _ in range(r.choice([0, 1, 30])))))
    d = spark.createDataFrame(rows, "id long, declared string, suffix string, domain string, host string, text string")
    got = {x["id"]: x for x in langid.identify(d).collect()}
    langs, grams = ["en", "fr"], {i: langid.grams(t) for i, *_, t in rows}
    table = {k: np.full(langid.GRAMS, 0.1) for k in langs}
    for i, dec, *_ in rows:
        if dec:
            np.add.at(table[dec], grams[i], 1)
    logp = {k: np.log(v / v.sum()) for k, v in table.items()}
    ll = {i: [float(logp[k][g].mean()) if len(g) else 0.0 for k in langs] for i, g in grams.items()}
    best = {i: int(np.argmax(ll[i])) for i, g in grams.items() if len(g)}
    total = np.array([1.0 + sum(b == k for b in best.values()) for k in (0, 1)])
    share = total / total.sum()
    count = lambda f: np.array([sum(best.get(x[0]) == k and f(x) for x in rows) for k in (0, 1)], dtype=float)
    smooth = lambda c, p: (c + 5 * p) / (c.sum() + 5)
    for x in rows:
        i, dec, suf, dom, host, _ = x
        prior = smooth(count(lambda y: (y[4], y[3]) == (host, dom)), smooth(count(lambda y: y[3] == dom), share)) if any(y[0] in best and (y[4], y[3]) == (host, dom) for y in rows) else share
        fused = np.array(ll[i]) * min(len(grams[i]), 150) + np.log(prior)
        for at, value in ((1, dec), (2, suf)):
            if value is not None and any(y[0] in best and y[at] == value for y in rows):
                fused += np.log((count(lambda y, at=at, value=value: y[at] == value) + share) / total)
        assert got[i]["lang"] == langs[int(np.argmax(fused))]
        assert got[i]["confidence"] == pytest.approx(1 / np.exp(fused - fused.max()).sum(), abs=2e-4)


def passages(text):
    """(level, lines) of each run of neighbouring lines of one level, by a walk over the lines; a blank unquoted line is no passage."""
    out, last = [], None
    for raw in (text or "").split("\n"):
        level, line = 0, raw
        while line.lstrip(" \t").startswith(">"):
            level, line = level + 1, line.lstrip(" \t")[1:]
        line = " ".join(line.lower().split())
        if level == 0 and not line:
            last = None
            continue
        if level != last:
            out.append((level, []))
        out[-1][1].append(line)
        last = level
    return out


def units(lines):
    whole = " ".join(x for x in lines if x)
    sentences, at = [], 0
    for i, c in enumerate(whole):
        if c in ".!?" and whole[i + 1 : i + 2] == " ":
            sentences.append(whole[at : i + 1])
            at = i + 2
    return {whole, *lines, *sentences, whole[at:]} - {""}


def test_quotations_by_brute_force(spark):
    r = random.Random(25)
    pool = ["Good morning.", "How is the river today?", "It rose again.", "I see.", "Stones and more stones.", "The bridge is shut! Go round by the mill.", ""]
    wrap = lambda text, mark: "\n".join(f"{mark}{x}" for x in textwrap.wrap(text, r.choice([9, 20, 60])))
    rows = []
    for c in range(4):
        past = []
        for t in range(16):
            own = [" ".join(r.choice(pool) for _ in range(r.randrange(1, 4))) + (f" Line {c} {t}." if r.random() < 0.6 else "") for _ in range(r.randrange(3))]
            text = []
            for _ in range(r.randrange(4) if past else 0):  # passages wrapped anew, between words of one's own
                text.append(wrap(r.choice(past), r.choice(["> ", ">", "> > ", ">>"])))
                text.append(r.choice(["", "I agree.", "> ", "Not so!"]))
            text += ["\n\n".join(wrap(x, "") for x in own)]
            past += [x for x in own if x.strip()]
            rows.append((c, t, "user", "\n".join(text)))
    got = {(x["conv_id"], x["turn"]): x["parent_turn"] for x in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), step=3).collect()}
    linked = 0
    for c, t, _, text in rows:
        score = collections.Counter()
        for level, unit in {(level, u) for level, lines in passages(text) if level for u in units(lines)}:
            for c2, t2, _, text2 in reversed([x for x in rows if x[0] == c and x[1] < t]):
                own = [lines for level2, lines in passages(text2) if level2 == 0]
                if unit in {u for lines in own for u in units(lines)} | {" ".join(x for lines in own for x in lines)}:
                    score[level, t2] += len(unit)
                    break
        want = max(score, key=lambda k: (-k[0], score[k], k[1]))[1] if score else None
        assert got[c, t] == want
        linked += want is not None
    assert linked > 20


def test_passages_between_own_words_link(spark):
    """Two passages, wrapped anew, with the reply's own words between them; a very long thread; ties go to the later message."""
    first = "The river rises in the hills and runs past four mills.\n\nBelow the last of them it is deep and slow, and boats go up from the sea."
    reply = "> The river rises in the hills\n> and runs past four mills.\nYes, it does.\n> Below the last of them it is deep and\n> slow, and boats go up from the sea.\nNot any more."
    rows = [(1, 0, "user", first), (1, 1, "assistant", "Other words."), (1, 2, "user", reply), (2, 0, "user", "Same words."), (2, 1, "user", "Same words."), (2, 2, "user", "> same  WORDS.")]
    rows += [(3, t, "user", (f"> word {t - 1}\n" if t else "") + f"word {t}") for t in range(600)] + [(4, 0, "user", "long word " * 60_000), (4, 1, "user", "> " + "long word " * 60_000)]
    got = {(x["conv_id"], x["turn"]): x for x in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2]["parent_turn"] == 0 and got[1, 2]["n_quoted_lines"] == 4 and got[1, 2]["text"] == "Yes, it does.\nNot any more."
    assert got[2, 2]["parent_turn"] == 1 and got[4, 1]["parent_turn"] == 0
    assert all(got[3, t]["parent_turn"] == t - 1 and got[3, t]["depth"] == t for t in range(1, 600))


def test_very_long_texts(spark):
    """A text of 120,000 words, its copy with a few words changed, and one without white space."""
    r = random.Random(26)
    w = [f"{r.choice('abcdefgh')}{r.randrange(3000)}" + ("." if i % 17 == 0 else "") for i in range(120_000)]
    v = list(w)
    for i in range(0, 120_000, 20_000):
        v[i] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, "x" * 300_000), (4, "short one")]
    d = spark.createDataFrame([(*x, "en", "s") for x in rows], "doc_id long, text string, lang string, source string")
    assert {x["doc_id"]: x["component_id"] for x in jaccard.components(d, 3, 90).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    q = {x["doc_id"]: x for x in quality.quality(d).collect()}
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[t] > 1 for j in range(3)}
    assert (q[1]["n_words"], q[1]["n_repeat_words"], q[3]["word_chars"]) == (120_000, len(cover), 300_000)
    s = {x["doc_id"]: x for x in sentspans.dedup_spans(d).collect()}
    assert s[1]["n_removed"] == 0
    assert s[2]["n_removed"] > 0.9 * s[2]["n_sentences"]
    assert {x["doc_id"] for x in secrets.scan(d).collect()} == {1, 2, 3, 4}
    assert all(x["round_trip"] for x in spiece.encode(d).collect())
    assert sum(x["taken"] for x in mixing.mix(d).collect()) == pytest.approx(1.5 * 240_003, rel=0.02)
    assert {x["doc_id"] for x in langid.identify_documents(d).collect()} == {1, 2, 3, 4}


def test_vectors_reach_parts_and_recall(spark):
    """On sf0.1's vectors the router has 16 parts; on clustered ones few of them are asked."""
    assert [ann.parts_for(n, 2_000, 16, 1_024) for n in (0, 15, 100, 256, 2_000, 64_000, 10**9)] == [1, 1, 4, 16, 16, 32, 1_024]
    r = np.random.default_rng(3)
    x = (6 * r.normal(0, 1, (16, 24))[np.arange(2_000) % 16] + r.normal(0, 1, (2_000, 24))).astype(np.float64)
    router, probes = ann.learn(x, 16, 20, 0.97)
    assert probes <= 4
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = e.collect()
    ids, v = np.array([y["vec_id"] for y in rows]), np.array([y["embedding"] for y in rows], dtype=float)
    hits = asked = 0
    found = collections.defaultdict(set)
    for g in ann.nearest(e).collect():
        found[g["query_id"]].add(g["vec_id"])
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        hits += len(found[int(ids[i])] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        asked += 20
    assert hits / asked >= 0.9


def test_extra_columns_and_empty_tables(spark):
    vec = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], "clash", "clash") for i in range(60)], "vec_id long, embedding array<float>, part string, v string")
    assert ann.nearest(vec, k=3).count() == 9
    assert ann.nearest(vec.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "a b", "clash", "clash")], "doc_id long, text string, ids string, x string")
    labels = spark.createDataFrame([(1, 1, "clash")], "doc_id long, toxic int, text string")
    assert toxicity.score(d, labels).count() == 1
    assert toxicity.score(d.limit(0), labels).count() == 0
    assert toxicity.score(d, labels.limit(0)).first()["score"] == 0.0
    assert spiece.encode(d.limit(0)).count() == 0
    assert jaccard.components(d.limit(0)).count() == 0
    m = spark.createDataFrame([(1, 0, "user", "x", "clash")], "conv_id long, turn long, role string, text string, parent string")
    assert chat.link_quotations(m.limit(0)).count() == 0
    assert chat.link_quotations(m).count() == 1


def test_sample_of_rows_without_id_is_bounded(spark):
    d = spark.createDataFrame([(None, "abcdef ghijkl mnopqr")] * 3000, "doc_id long, text string")
    n = secrets.labelled_samples(d, sample_docs=5, n_random=10).filter("not random").count()
    assert n == 5 * 2 * 4


def test_lexicons_of_folds_have_not_seen_their_labels(spark):
    rows = [(i, int(i < 30), i % 3, "vile word" if i < 30 and i % 3 == 0 else "kind word") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, toxic int, fold int, text string")
    every, without, *_ = toxicity.learn_lexicons(d, 3)
    assert "vile" in every[0]
    assert "vile" not in without[0]
    assert math.isfinite(every[0]["vile"])
    assert F is not None


def test_many_secrets_of_one_text(spark):
    """Starts, containment and masks of a text with thousands of hits, beyond one block of each, against a walk over the text."""
    r = random.Random(41)
    parts, t = [], ""
    for i in range(6_000):
        parts.append(r.choice(["é🙂 plain words, ", "\n", "x"]) + r.choice([f"{r.getrandbits(128):032x}", f"token = '{r.getrandbits(96):024x}Qz'", "AKIA" + "".join(r.choice("ABCDEFG234567") for _ in range(16)), "word"]) + " ")
    t = "".join(parts)
    d = spark.createDataFrame([(1, t), (2, "no hit"), (3, None), (4, "")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in secrets.find_secrets(d).collect()}
    want = []
    for k, pattern in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX)):
        want += [(m.start(), k, m.end(), m.group()) for m in re.finditer(pattern, t) if k or len(m.group(1)) >= 12]
    assert [tuple(x) for x in got[1]["base"]] == sorted(want) and len(want) > 4_000
    found = [tuple(x) for x in got[1]["found"]]
    for a, k, b, v in found:
        assert t[a:b] == v
        if k == 3:
            assert not any(x <= a and b <= y for x, _, y, _ in want)
    out, at = [], 0
    for a, _, b, _ in sorted(found):
        if a >= at:
            out += [t[at:a], secrets.MASK]
        at = max(at, b)
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(d).collect()}
    assert clean == {1: "".join([*out, t[at:]]), 2: "no hit", 3: None, 4: ""}


def test_markov_spans_by_plain_scores(spark):
    """The spans of the models are the candidates whose mean log-ratio, by a loop over the table, reaches the bound."""
    r = random.Random(42)
    texts = [" ".join(r.choice(["ordinary_identifier_name", "someCamelCaseIdentifierName", "".join(r.choice("abcdefXYZ0123456789qwWK") for _ in range(28)), "path/to/the/very-long-file_name", "plain words here"]) for _ in range(30)) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    samples = secrets.labelled_samples(d).cache()
    table = secrets.train(samples)
    code = lambda c: secrets.ALPHABET.find(c) + 1

    def mean(v):
        return sum(table[code(a) * secrets.STATES + code(b)] for a, b in zip(v, v[1:], strict=False)) / (len(v) - 1)

    hits = 0
    for x in secrets.find_secrets(d, samples=samples).collect():
        t, base = texts[x["doc_id"]], [(y["start"], y["end"]) for y in x["base"]]
        want = []
        for m in re.finditer(secrets.CANDIDATE, t):
            v = m.group()
            mixed = any(map(str.isdigit, v)) or any(map(str.islower, v)) and any(map(str.isupper, v))
            least = 1.5 if any(map(str.isdigit, v)) else 2.0
            if any(map(str.isalpha, v)) and mixed and mean(v) >= least and not any(a <= m.start() and m.end() <= b for a, b in base):
                want.append((m.start(), m.end()))
        assert [(y["start"], y["end"]) for y in x["found"] if y["kind"] == 3] == want
        hits += len(want)
    assert hits > 20
