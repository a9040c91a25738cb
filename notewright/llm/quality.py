"""Quality rules: base rules on words and repetition, and the divergence of a document's histograms from its language's.

Two histograms per document are held against the reference of its declared language: character classes (lower,
upper, digit, beyond ASCII, white space, prose punctuation, other symbols) and common function words (those of
``COMMON`` for the language, and all other words). A reference is the sum of the histograms of all documents that
declare the language, by grouped aggregation. The distance is Jensen-Shannon's (square root of the divergence in
bits, 0 to 1). A document shorter than ``min_chars`` or ``min_words``, or a language with fewer than ``min_ref_words`` words
in all, isn't judged by that histogram; a language without a list of common words is judged by characters alone.

DataFrame functions only. A null text is an empty one: no words, base_failed. A null lang is a language of its own.
Repeated rows are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, store, words

#: Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that it for on with as was are be at by this from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
N_COMMON = 20
SYMBOLS = r"#*$%&|<>"


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeated_words(d: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words that lie in a 3-word window found twice or more in the text.

    A window's hash and its place are packed into one long (as many low bits as the place needs), so that one
    sort of longs brings equal windows together.
    """
    n = F.size("q_words")
    d = d.withColumn("q_bits", F.when(n > 2, F.length(F.bin(n))).otherwise(F.lit(1)))
    packed = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)), F.col("q_bits")).bitwiseOR(i.cast("long")),
    )
    d = d.withColumn("q_packed", F.when(n > 2, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    high = lambda x: F.call_function("shiftrightunsigned", x, F.col("q_bits"))
    same = lambda x, j: F.coalesce(high(F.get("q_packed", j)) == high(x), F.lit(False))
    twice = F.filter("q_packed", lambda x, j: same(x, j + 1) | same(x, j - 1))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q_bits")) - 1)
    d = d.withColumn("q_at", F.sort_array(F.transform(twice, place)))
    widths = F.transform("q_at", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("q_at", j + 1) - p, F.lit(3).cast("long"))))
    return d.withColumn("n_repeat_words", F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)).drop("q_packed", "q_at", "q_bits")


def _char_classes(d: DataFrame) -> DataFrame:
    """Adds q_chars: counts of lower, upper, digit, beyond ASCII, white space, prose punctuation, other; removing class after class."""
    steps = ["[a-z]+", "[^\\x00-\\x7F]+", f"[{SPACE}]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+"]
    left, counts = "q_text", []
    for i, pattern in enumerate(steps):
        d = d.withColumn(f"q_left{i}", F.regexp_replace(left, pattern, ""))
        counts.append(F.length(left) - F.length(f"q_left{i}"))
        left = f"q_left{i}"
    return d.withColumn("q_chars", F.array(*counts, F.length(left)).cast("array<bigint>")).drop(*[f"q_left{i}" for i in range(len(steps))])


def _common_words(d: DataFrame) -> DataFrame:
    """Adds q_common: counts of the language's common words in list order, then of all other words; null without a list."""
    lists = None
    for lang, found in COMMON.items():
        listed = F.array(*[F.lit(w) for w in found])
        lists = F.when(F.col("lang") == lang, listed) if lists is None else lists.when(F.col("lang") == lang, listed)
    d = d.withColumn("q_list", lists)
    short = F.filter("q_words", lambda w: F.length(w) <= max(len(w) for ws in COMMON.values() for w in ws))
    letter = lambda w: F.substring(F.lit("abcdefghijklmnopqrst"), F.array_position("q_list", F.lower(w)).cast("int"), F.lit(1))
    listed = F.filter(F.transform(short, lambda w: F.when(F.array_position("q_list", F.lower(w)) > 0, letter(w)).otherwise(F.lit(""))), lambda c: c != "")
    d = d.withColumn("q_codes", F.when(F.col("q_list").isNotNull(), F.array_join(listed, "")))
    counts = [F.length("q_codes") - F.length(F.replace("q_codes", F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrst"]
    d = d.withColumn("q_common", F.when(F.col("q_codes").isNotNull(), F.array(*counts, F.size("q_words") - F.length("q_codes")).cast("array<bigint>")))
    return d.drop("q_list", "q_codes")


def features(docs: DataFrame) -> DataFrame:
    """One narrow row per document: base counts and both histograms. One pass over the texts, no shuffle."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("q_text")).withColumn("q_words", words(F.col("q_text")))
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.withColumn("q_lines", lines)
    d = d.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
    d = _common_words(_char_classes(_repeated_words(d)))
    return d.select(
        "doc_id", "lang", F.size("q_words").cast("long").alias("n_words"), _length_without(F.col("q_text"), f"[{SPACE}]+").cast("long").alias("word_chars"),
        (F.length("q_text") - _length_without(F.col("q_text"), f"[{SYMBOLS}]+")).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "q_chars", "q_common",
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; null if one is null or sums to 0."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    share = lambda x: F.transform(x, lambda v: v / total(x))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    each = F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    jsd = F.aggregate(each, F.lit(0.0), lambda a, v: a + v)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(jsd, F.lit(0.0))))


def references(feats: DataFrame) -> DataFrame:
    """Per language: r_chars, r_common (sums over all its documents) and r_words."""
    sums = [F.sum(F.col("q_chars")[i]).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("q_common", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    r = feats.groupBy("lang").agg(F.sum("n_words").alias("r_words"), *sums)
    return r.select(
        F.col("lang").alias("r_lang"), "r_words", F.array(*[F.col(f"c{i}") for i in range(7)]).alias("r_chars"),
        F.when(F.col("w0").isNotNull(), F.array(*[F.col(f"w{i}") for i in range(N_COMMON + 1)])).alias("r_common"),
    )


def quality(docs: DataFrame, max_char_js: float = 0.25, max_word_js: float = 0.28, min_chars: int = 300, min_words: int = 100, min_ref_words: int = 2_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_js, word_js."""
    f = store(features(docs), "quality")
    ref = broadcast_if_small(store(references(f), "quality-ref"), 10_000)
    d = f.join(ref, F.col("lang").eqNullSafe(F.col("r_lang")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("r_words") >= min_ref_words
    d = d.withColumn("base_failed", base)
    d = d.withColumn("char_js", F.when(enough & (F.col("word_chars") >= min_chars), js_distance(F.col("q_chars"), F.col("r_chars"))))
    d = d.withColumn("word_js", F.when(enough & (F.col("n_words") >= min_words), js_distance(F.col("q_common"), F.col("r_common"))))
    ok = (F.coalesce("char_js", F.lit(0.0)) <= max_char_js) & (F.coalesce("word_js", F.lit(0.0)) <= max_word_js)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept"), F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js"))
