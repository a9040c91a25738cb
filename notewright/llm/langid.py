"""Language ID by Bayesian fusion of evidence.

Four kinds of evidence are added as log-likelihoods for each language:

* the text: hashed byte trigrams under a model per declared language, counted over all texts; the mean over the text,
  times its trigrams but ``most_grams`` at most, as neighbouring trigrams aren't independent;
* the declared markup language, and the address suffix: P(value | language) from counts of all rows by the language
  that their text shows, smoothed;
* the host's prior: counts of the host's rows by text language, smoothed towards its domain's, which are
  smoothed towards all rows'.

The languages are all that at least ``min_rows`` rows declare, however small their share. Their trigram tables (65,536 numbers, 256 KB
each) are all that driver and workers hold; ``most_langs`` bounds that memory. Rows that declare a language beyond it keep
that language as lang where their text fits none of the others, and are never rejected.

A row is rejected if its text fits no language (its mean log-likelihood lies ``far`` deviations below that of its language's rows) and it doesn't declare one without a model, or if the
fused language contradicts a declared one with at least ``sure`` confidence; rows with fewer than ``min_grams`` trigrams (for the
first reason, three times that) are never rejected. A null or empty text gives no text evidence; a null declaration, suffix or host gives none of its own. Without any declared
language lang is null and nothing is rejected. Repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, store

GRAMS = 65_536


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased UTF-8 bytes; all ASCII but letters is space, runs of it are one."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    raw = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, 32)
    b = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.int64)
    if len(b) < 5:
        return b[:0]
    return (b[:-2] * 961 + b[1:-1] * 31 + b[2:] * 7919 + (b[:-2] ^ b[2:]) * 257) % GRAMS


def _languages(d: DataFrame, min_rows: int, most_langs: int) -> list[str]:
    c = d.filter("declared is not null").groupBy("declared").count().filter(F.col("count") >= min_rows)
    return sorted(r["declared"] for r in c.orderBy(F.desc("count"), "declared").limit(most_langs).collect())


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), GRAMS), dtype=np.int64)
        at = {x: i for i, x in enumerate(langs)}
        for b in batches:
            for lang, text in zip(b.column("declared").to_pylist(), b.column("text").to_pylist(), strict=True):
                if lang in at:
                    g = grams(text)
                    if len(g):
                        total[at[lang]] += np.bincount(g, minlength=GRAMS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["l", "g", "n"])

    return run


def text_model(d: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(trigram | language), languages x GRAMS, from all rows with a declared language."""
    c = d.select("declared", "text").mapInArrow(_count(langs), "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((len(langs), GRAMS), 0.1)
    n[c["l"].to_numpy(), c["g"].to_numpy()] += c["n"].to_numpy()
    return np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def identify(rows: DataFrame, min_rows: int = 3, most_langs: int = 256, most_grams: int = 150, min_grams: int = 60, sure: float = 0.99, far: float = 8.0, prior_weight: float = 5.0) -> DataFrame:
    """Adds n_grams, text_lang, lang, confidence, rejected to (id, declared, suffix, domain, host); ``rows`` needs those and text."""
    d = rows.select("id", "declared", "suffix", "domain", "host", "text")
    langs = _languages(d, min_rows, most_langs)
    names = F.array(*[F.lit(x) for x in langs]).cast("array<string>")
    k = len(langs)
    if not k:
        none = [F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("rejected")]
        return d.select("id", "declared", "suffix", "domain", "host", F.lit(0).cast("long").alias("n_grams"), *none)
    model = rows.sparkSession.sparkContext.broadcast(text_model(d, langs))

    keep = ["id", "declared", "suffix", "domain", "host"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            n, ll = [], []
            for text in b.column("text").to_pylist():
                g = grams(text)
                n.append(len(g))
                # A long text's trigrams are added up in pieces, so they take languages x GRAMS numbers at most.
                pieces = (m[:, g[i : i + GRAMS]].sum(1, dtype=np.float64) for i in range(0, len(g), GRAMS))
                ll.append(sum(pieces, np.zeros(len(m))) / max(len(g), 1))
            columns = [*[b.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_grams", "ll"])

    kinds = ", ".join(f"{c} {t}" for c, t in d.drop("text").dtypes)
    s = store(d.mapInArrow(run, f"{kinds}, n_grams long, ll array<double>"), "langid-scores")
    top = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    s = s.withColumn("best", F.when(F.col("n_grams") > 0, top)).withColumn("fit", F.when(F.col("n_grams") >= 3 * min_grams, F.array_max("ll")))
    each = [F.sum((F.col("best") == i).cast("long")).alias(f"c{i}") for i in range(k)]

    def counted(*by: str) -> DataFrame:
        c = s.filter("best is not null").groupBy(*by).agg(*each)
        return c.select(*by, _array([F.col(f"c{i}") for i in range(k)]).alias("c"))

    fits = [F.avg(F.when(F.col("best") == i, F.col("fit"))).alias(f"m{i}") for i in range(k)] + [F.stddev(F.when(F.col("best") == i, F.col("fit"))).alias(f"s{i}") for i in range(k)]
    g = s.agg(*[F.coalesce(x, F.lit(0)).alias(f"c{i}") for i, x in enumerate(each)], *fits).collect()[0]
    total = np.array([g[f"c{i}"] for i in range(k)], dtype=float) + 1.0
    share = total / total.sum()
    all_share = F.array(*[F.lit(float(x)) for x in share])
    all_count = F.array(*[F.lit(float(x)) for x in total])
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    smooth = lambda c, prior: F.zip_with(c, prior, lambda x, p: (x + prior_weight * p) / (size(c) + prior_weight))

    def given(c: Column) -> Column:
        """log P(value | language) up to a constant of the value, from the value's counts by language."""
        return F.zip_with(F.zip_with(c, all_share, lambda x, p: x + p), all_count, lambda x, n: F.log(x / n))

    domains = store(counted("domain").select(F.col("domain").alias("d_domain"), smooth(F.col("c"), all_share).alias("d_prior")), "langid-domains")
    hosts = counted("host", "domain").join(domains, F.col("domain").eqNullSafe(F.col("d_domain")), "left")
    hosts = store(hosts.select(F.col("host").alias("h_host"), F.col("domain").alias("h_domain"), smooth(F.col("c"), F.coalesce("d_prior", all_share)).alias("prior")), "langid-hosts")
    declared = store(counted("declared").select(F.col("declared").alias("e_declared"), given(F.col("c")).alias("e_ll")), "langid-declared")
    suffixes = store(counted("suffix").select(F.col("suffix").alias("x_suffix"), given(F.col("c")).alias("x_ll")), "langid-suffixes")
    s = s.join(broadcast_if_small(hosts, 100_000), (F.col("host") == F.col("h_host")) & F.col("domain").eqNullSafe(F.col("h_domain")), "left")
    s = s.join(broadcast_if_small(declared, 10_000), F.col("declared") == F.col("e_declared"), "left").join(broadcast_if_small(suffixes, 10_000), F.col("suffix") == F.col("x_suffix"), "left")
    nil = F.array(*[F.lit(0.0)] * k)
    cap = F.least(F.col("n_grams"), F.lit(most_grams))
    parts = [F.transform("ll", lambda x: x * cap), F.coalesce("e_ll", nil), F.coalesce("x_ll", nil), F.transform(F.coalesce("prior", all_share), lambda p: F.log(p))]
    fused = parts[0]
    for p in parts[1:]:
        fused = F.zip_with(fused, p, lambda a, b: a + b)
    s = s.withColumn("fused", fused)
    peak = F.array_max("fused")
    s = s.withColumn("confidence", 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - peak)))
    s = s.withColumn("lang", F.get(names, F.array_position("fused", peak).cast("int") - 1)).withColumn("text_lang", F.get(names, F.col("best")))
    floor = F.array(*[F.lit(float(g[f"m{i}"] - far * g[f"s{i}"]) if g[f"s{i}"] is not None else -1e9) for i in range(k)])
    modelled = F.col("declared").isNull() | F.array_contains(names, F.col("declared"))
    unlike = F.coalesce(F.col("fit") < F.get(floor, F.col("best")), F.lit(False))
    odd = modelled & unlike
    other = F.coalesce((F.col("n_grams") >= min_grams) & F.array_contains(names, F.col("declared")) & (F.col("lang") != F.col("declared")) & (F.col("confidence") >= sure), F.lit(False))
    return s.select("id", "declared", "suffix", "domain", "host", "n_grams", "text_lang", F.when(~modelled & unlike, F.col("declared")).otherwise(F.col("lang")).alias("lang"), F.round("confidence", 6).alias("confidence"), (odd | other).alias("rejected"))


def identify_pages(pages: DataFrame, **kw) -> DataFrame:
    """page_id, declared, suffix, domain, host, n_grams, text_lang, lang, confidence, rejected of web pages (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"&[A-Za-z]{1,8};|&#[0-9A-Fa-fxX]{1,8};", " ")
    none = lambda c: F.when(c != "", c)
    declared = none(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1)))
    host = none(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^(www|m)\.", ""))
    d = pages.select(F.col("page_id").alias("id"), declared.alias("declared"), host.alias("host"), text.alias("text"))
    d = d.withColumn("domain", none(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))).withColumn("suffix", none(F.regexp_extract("host", r"([^.]+)$", 1)))
    return identify(d, **kw).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, lang, ... of documents: lang is what they declare, their source stands for the host."""
    d = docs.select(F.col("doc_id").alias("id"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("domain"), F.col("source").alias("host"), "text")
    return identify(d, **kw).withColumnRenamed("id", "doc_id")
