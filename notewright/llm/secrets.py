"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models are order-1 transition tables over the characters of keys and identifiers, counted from labelled
samples: seeded random strings (hexadecimal, base64, base62) against words of a bounded sample of documents and
identifiers made of them (``word``, ``word_word``, ``wordWord``, ``word123``). A candidate token (20 characters or more, with a
letter and a digit, or letters of both cases) is flagged when the mean log-likelihood ratio of its transitions reaches ``min_llr``, or
``bare_llr`` if it holds no digit.

DataFrame functions only. Offsets are code points, ends exclusive. A null text is an empty one and has no span; a
null doc_id stays null; repeated rows are scanned each; an empty table gives an empty result and, for lack of
words, models of random strings against a flat table. Spans of the models that lie within a pattern's span are dropped; those that
reach beyond it stay beside it. Texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
MASK = "[SECRET]"


#: Least elements of a block of ``_running``, and code points of a block of text in ``redact``.
BLOCK, TEXT_BLOCK = 64, 4096


def _fold(x: Column, first: Column, op) -> Column:
    zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, v):
        at = op(acc["at"], v)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(x, zero, step, lambda acc: acc["out"])


def _running(x: Column, op) -> Column:
    """op (addition, greatest) over the elements so far of an array of counts, for each element.

    Blocks of about the root of the size are folded by themselves, behind the totals of those before them: appending copies what is there, and
    a slice reads its whole array, so either alone takes the square of the size.
    """
    width = lambda a: F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(BLOCK)).cast("int")
    block = lambda a, b: F.slice(a, b * width(a) + 1, width(a))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width(a)).cast("int") - 1), lambda b: block(a, b))

    def each(cut: Column) -> Column:
        totals = F.transform(cut, lambda c: F.aggregate(c, F.lit(0), op))
        before = F.concat(F.array(F.lit(0)), _fold(totals, F.lit(0), op))
        return let(before, lambda at: F.flatten(F.transform(cut, lambda c, b: _fold(c, F.get(at, b), op))))

    return F.when(F.size(x) > 0, let(let(x, blocks), each)).otherwise(F.array().cast("array<int>"))


def _starts(matches: Column, gaps: Column) -> Column:
    """Start of each match: the lengths of the gaps up to it and of the matches before it."""
    steps = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.length(m) + F.length(g))
    return F.zip_with(_running(steps, lambda a, b: a + b), matches, lambda end, m: end - F.length(m))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that lie in none of ``base``: no base span that starts before or with one reaches to its end."""
    shape = lambda x, c: F.struct(x["start"].alias("start"), F.lit(c).alias("c"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"))
    both = F.sort_array(F.concat(F.transform(base, lambda x: shape(x, 0)), F.transform(spans, lambda x: shape(x, 1))))

    def left(a: Column) -> Column:
        reach = _running(F.transform(a, lambda x: F.when(x["c"] == 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        free = F.filter(F.zip_with(a, reach, lambda x, r: F.struct(x.alias("x"), ((x["c"] == 1) & (r < x["end"])).alias("free"))), lambda z: z["free"])
        return F.transform(free, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["kind"].alias("kind"), z["x"]["end"].alias("end"), z["x"]["value"].alias("value")))

    return F.when(F.size(base) == 0, spans).otherwise(let(both, left))


def _find(d: DataFrame, name: str, pattern: str, kind: int, keep) -> DataFrame:
    """Adds ``name``: array of (start, kind, end, value) of the kept leftmost matches of ``pattern``."""
    hit = F.col("s_text").rlike(pattern)
    none = F.array().cast("array<string>")
    d = d.withColumn("s_hit", hit)
    d = d.withColumn("s_m", F.when(F.col("s_hit"), F.regexp_extract_all("s_text", F.lit(pattern), F.lit(0))).otherwise(none))
    d = d.withColumn("s_g", F.when(F.col("s_hit"), F.split("s_text", pattern, -1)).otherwise(none))
    d = d.withColumn("s_at", _starts(F.col("s_m"), F.col("s_g")))
    spans = F.zip_with("s_m", "s_at", lambda m, a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.length(m)).alias("end"), m.alias("value")))
    return d.withColumn(name, F.filter(spans, lambda x: keep(x["value"]))).drop("s_hit", "s_m", "s_g", "s_at")


def labelled_samples(docs: DataFrame, sample_docs: int = 400, n_random: int = 4000) -> DataFrame:
    """(value, random): seeded random strings and identifiers of the ``sample_docs`` documents first by hash of the doc_id."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("markov-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    size = (F.lit(20) + F.col("id") % 20).cast("int")
    rnd = spark.range(n_random).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, F.lit(1), size)).when(F.col("id") % 3 == 1, F.substring(b64, F.lit(1), size))
        .otherwise(F.substring(F.translate(b64, "+/=", "xQ7"), F.lit(1), size)).alias("value"), F.lit(True).alias("random"))
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("markov"))
    n = docs.count()
    every = docs.select(h.alias("h"), "text")
    few = every.filter(F.pmod("h", F.lit(2**31)) <= min(1.0, 4 * sample_docs / max(n, 1)) * 2**31)  # thins out what is sorted
    enough = few.limit(sample_docs).count() >= min(sample_docs, n)  # equal rows without an id share a hash, and may all be left out
    text = (few if enough else every).orderBy("h", "text").limit(sample_docs)
    w = text.select(F.filter(words(F.col("text")), lambda x: x.rlike("^[A-Za-z][A-Za-z_-]{2,}$")).alias("w"))
    pair = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
    p = w.filter(F.size("w") > 1).select(F.explode(pair).alias("p")).select("p.a", "p.b")
    made = F.array(F.col("a"), F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat("a", F.pmod(F.xxhash64("b"), F.lit(1000)).cast("string")))
    return rnd.unionByName(p.select(F.explode(made).alias("value"), F.lit(False).alias("random")))


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-ratios log P(b | a, random) - log P(b | a, identifier), STATES x STATES, row by row.

    Counted by grouped aggregation; the driver gets at most 2 x STATES x STATES counts.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1))
    s = samples.filter(F.length("value") > 1).select("value", "random", at.alias("i"))
    code = lambda i: F.call_function("locate", F.substring(F.col("value"), i, F.lit(1)), F.lit(ALPHABET))
    rows = s.select("random", code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b")).groupBy("random", "a", "b").count().collect()
    n = {True: [alpha] * STATES**2, False: [alpha] * STATES**2}
    for r in rows:
        n[r["random"]][r["a"] * STATES + r["b"]] += r["count"]
    out = []
    for a in range(STATES):
        row = slice(a * STATES, (a + 1) * STATES)
        tr, ti = sum(n[True][row]), sum(n[False][row])
        out += [round(math.log(x / tr) - math.log(y / ti), 6) for x, y in zip(n[True][row], n[False][row], strict=True)]
    return out


def llr(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the transitions of ``value``; 0 for fewer than two characters."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))

    def step(acc, c):
        more = F.when(acc["last"] >= 0, F.get(table, acc["last"] * STATES + c)).otherwise(F.lit(0.0))
        return F.struct(c.alias("last"), (acc["sum"] + more).alias("sum"))

    total = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    return F.when(F.length(value) > 1, total / (F.length(value) - 1)).otherwise(F.lit(0.0))


def find_secrets(docs: DataFrame, min_llr: float = 1.5, bare_llr: float = 2.0, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, text and ``base`` and ``found``: arrays of (start, kind, end, value), sorted by start and kind."""
    table = F.split(F.lit(",".join(map(str, train(labelled_samples(docs) if samples is None else samples)))), ",").cast("array<double>")
    d = docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("s_text"))
    d = _find(d, "s_assign", ASSIGN, 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 12)
    d = _find(d, "s_access", ACCESS, 1, lambda v: F.lit(True))
    d = _find(d, "s_hex", HEX, 2, lambda v: F.lit(True))
    d = _find(d, "s_markov", CANDIDATE, 3, lambda v: v.rlike("[A-Za-z]") & (v.rlike("[0-9]") | (v.rlike("[a-z]") & v.rlike("[A-Z]"))))
    d = d.withColumn("base", F.sort_array(F.concat("s_assign", "s_access", "s_hex")))
    d = d.withColumn("s_free", _outside(F.col("s_markov"), F.col("base")))
    least = lambda v: F.when(v.rlike("[0-9]"), F.lit(min_llr)).otherwise(F.lit(bare_llr))
    more = F.filter("s_free", lambda x: llr(x["value"], table) >= least(x["value"]))
    return d.withColumn("found", F.sort_array(F.concat("base", more))).select("doc_id", "text", "base", "found")


def _spelled(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    d = find_secrets(docs, **kw)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_markov"), F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.col("found")).alias("spans"))


def redact(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by MASK, and n_chars (where there is one) set anew.

    Overlapping spans become one mask. Other columns, and texts without a span, stay as they are.
    """
    keep = docs.columns
    kept = docs.select(F.struct(*keep).alias("doc_id"), "text")
    d = find_secrets(kept, **kw)
    n = TEXT_BLOCK

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text: the places of a long text are found from its block, not from its beginning."""
        at = lambda x: F.floor(x / n).cast("int")
        first, last = at(a), at(b - 1)
        several = F.concat(F.substring(F.get(blocks, first), a % n + 1, F.lit(n)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(blocks, last), F.lit(1), (b - 1) % n + 1))
        return F.when(b <= a, "").when(first == last, F.substring(F.get(blocks, first), a % n + 1, b - a)).otherwise(several)

    def masked(blocks: Column) -> Column:
        reach = _running(F.transform("found", lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def join(r: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(r, i - 1)).otherwise(0)
            parts = F.transform("found", lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(blocks, before(i), x["start"]), F.lit(MASK))).otherwise(""))
            return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(r, -1), F.length("text")))

        return let(reach, join)

    clean = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{n}}}"), F.lit(0)), masked)
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("text"))
    d = d.select("doc_id", text.alias("s_clean"))
    col = lambda c: F.col("s_clean").alias("text") if c == "text" else F.when(F.col("s_clean").isNotNull(), F.length("s_clean").cast("long")).otherwise(F.col("doc_id")[c]).alias(c) if c == "n_chars" else F.col("doc_id")[c].alias(c)
    return d.select(*[col(c) for c in keep])
