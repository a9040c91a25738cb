"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon of words and of word beginnings, learned from the training rows as those with
the highest log-odds of toxic documents; how often lexicon words stand within three words of a second-person
pronoun; rates of capitals, of exclamation and other punctuation, of symbols, and of obfuscated words (a letter-like
sign within a word), with lexicon hits that show only once such signs are read as letters. The trees (histogram splits, logistic
loss) are fitted on the driver on the features of at most ``max_rows`` labelled rows, taken by hash of the doc_id; the calibration on
predictions of folds whose labels neither the trees nor the lexicon have seen. Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from.

A null or empty text has all rates 0 and is scored as such. A null doc_id is not held out and has no label. Repeated rows are scored each;
a doc_id with several labels counts with each. Without labels of both kinds every score is the share of toxic rows (0 without any).
doc_ids pass through Arrow unchanged, whatever their size and beside nulls. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, words

STRIP = ".,;:!?\"'()[]{}|*#%&$<>-_"
#: Second-person pronouns of the four languages.
YOU = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes tú ti tus vosotros".split())
LEET = str.maketrans("0134578@$!", "oieastbasi")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$!*][^\W_]|[^\W\d_]\*+[^\W\d_]")
NAMES = (
    "log_words", "hit_rate", "hit_weight", "hit_max", "hit_kinds", "stem_rate", "stem_weight", "stem_max", "leet_rate", "you_near", "you_rate",
    "capital_rate", "caps_word_rate", "bang_rate", "punct_rate", "symbol_rate", "obfuscated_rate",
)


def dense(text: str | None, lexicon: dict[str, float], stems: dict[str, float], lengths: tuple[int, ...]) -> list[float]:
    """The features in the order of NAMES."""
    text = text or ""
    raw = text.split()
    n = max(1, len(raw))
    ws = [w.strip(STRIP) for w in text.lower().split()]
    at = [i for i, w in enumerate(ws) if w in lexicon]
    found = [lexicon[ws[i]] for i in at]
    stem = [stems[w[:k]] for k in lengths for w in ws if w[:k] in stems and len(w) > k]
    odd = [i for i, w in enumerate(ws) if not w.isalpha() and OBFUSCATED.search(w)]
    leet = [i for i in odd if (r := ws[i].translate(LEET)) in lexicon or r.replace("*", "") in lexicon]
    near = sum(1 for i in {*at, *leet} if not YOU.isdisjoint(ws[max(0, i - 3) : i + 4]))
    chars = max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        math.log1p(len(raw)), len(at) / n, sum(found) / n, max(found, default=0.0), float(len({ws[i] for i in at})), len(stem) / n, sum(stem) / n, max(stem, default=0.0),
        len(leet) / n, near / n, sum(1 for w in ws if w in YOU) / n, upper / chars, sum(1 for w in raw if len(w) > 1 and w.isupper()) / n,
        text.count("!") / n, sum(map(text.count, ".,;:?")) / n, sum(map(text.count, "#*$%&|<>@")) / n, len(odd) / n,
    ]


Lexicon = tuple[dict[str, float], dict[str, float]]


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Rows of dense features, one for each text."""
    lengths = tuple(sorted({len(s) for s in lexicon[1]}))
    return np.array([dense(t, *lexicon, lengths) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def featured(rows: DataFrame, lexicons: list[Lexicon], keep: list[str]) -> DataFrame:
    """``keep`` and the features under each lexicon as one array column ``x``."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.concatenate([features(texts, lex) for lex in lexicons], axis=1)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(list(x), pa.list_(pa.float64()))], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def learn_lexicons(train: DataFrame, folds: int, size: int = 150, stem_lengths: tuple[int, ...] = (5, 6, 7), min_docs: int = 4, min_odds: float = 2.0) -> list[Lexicon]:
    """Words and word beginnings with the highest log-odds of toxic documents, at most ``size`` of each, with the log-odds as weights.

    First those of all rows of ``train``, then for each fold those of the rows of other folds; one pass counts for all.
    """
    strip = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}]+|[^\p{L}]+$", "")
    d = train.select("toxic", "fold", F.array_distinct(F.transform(words(F.col("text")), strip)).alias("w"))
    kinds = range(-1, folds)
    counts = [F.sum(F.when(F.col("fold") != k, c).otherwise(0)).alias(f"{n}{k + 1}") for k in kinds for n, c in (("p", F.col("toxic")), ("n", F.lit(1)))]
    totals = train.agg(*counts).collect()[0]

    def beginnings(k: int):
        return F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k)))

    stemmed = [beginnings(k) for k in stem_lengths]
    terms = F.array_distinct(F.concat(F.transform("w", lambda w: F.concat(F.lit("0:"), w)), *stemmed))
    c = store(d.select("toxic", "fold", F.explode(terms).alias("t")).groupBy("t").agg(*counts).filter(F.col("p0") >= min_docs), "toxic-terms")
    out = []
    for k in kinds:
        p, n = F.col(f"p{k + 1}"), F.col(f"n{k + 1}")
        pos = totals[f"p{k + 1}"] or 0
        neg = (totals[f"n{k + 1}"] or 0) - pos
        odds = F.log((p + 0.5) / (pos - p + 0.5)) - F.log((n - p + 0.5) / (neg - n + p + 0.5))
        each = c.filter(p >= min_docs).withColumn("odds", odds).filter(F.col("odds") >= min_odds)
        found = []
        for kind in (F.col("t").startswith("0:") & (F.length("t") > 4), ~F.col("t").startswith("0:")):
            top = each.filter(kind).orderBy(F.desc(F.col("odds") * F.log1p(p)), "t").limit(size).collect()
            found.append({r["t"][2:]: round(r["odds"], 6) for r in top})
        out.append((found[0], found[1]))
    return out


class Trees:
    """Boosted regression trees on the logistic loss: quantile bins, level-wise splits, shrunken Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(rate / (1 - rate))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        score, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-6)
                local = node - first
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = local * width + binned[:, f]
                    gs, hs, ns = (np.bincount(key, w, n * width).reshape(n, width).cumsum(1) for w in (g, h, np.ones(len(y))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(ns < self.least) | (nt - ns < self.least)] = -1
                    gain = gain[:, : len(c)]
                    at = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(n), at] > best):
                        best[k], feature[first + k], cut[first + k] = gain[k, at[k]], f, c[at[k]]
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            score = score + value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean score, mean label) of the blocks, both ascending."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, v, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, v2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + v2, blocks[-1][2] + n2]
    return np.array([s / n for s, _, n in blocks]), np.array([v / n for _, v, n in blocks])


class Model:
    """Trees and calibration of one training run: ``x`` under the lexicon of all rows, ``unseen[k]`` under that of the rows outside fold k."""

    def __init__(self, x: np.ndarray, unseen: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if len(np.unique(y)) < 2:
            return
        out = np.zeros(len(y))
        for k, z in enumerate(unseen):
            rest = fold != k
            if (~rest).any():
                out[~rest] = Trees().fit(z[rest], y[rest]).predict(z[~rest]) if len(np.unique(y[rest])) == 2 else self.share
        self.knots = isotonic(out, y)
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw one keeps an order within the calibration's steps."""
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.predict(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * raw, 0, 1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, folds: int = 3) -> tuple[Model, Lexicon]:
    """(model, lexicon) from at most ``max_rows`` labelled rows that aren't held out."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    ids = store(ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows), "toxic-ids")
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    rows = store(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", fold, "text"), "toxic-train")
    lexicons = learn_lexicons(rows, folds)
    got = featured(rows, lexicons, ["doc_id", "toxic", "fold"])
    # As many rows as labels, unless documents repeat a doc_id: the driver gets no more than ``max_rows`` of those either.
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("x")).limit(max_rows).toPandas().sort_values(["doc_id", "toxic"])
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), folds + 1, len(NAMES))
    return Model(x[:, 0], [x[:, k + 1] for k in range(folds)], got["toxic"].to_numpy(dtype=float), got["fold"].to_numpy(dtype=int)), lexicons[0]


def score(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model, lexicon = train(docs, labels, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column("text").to_pylist(), lexicon))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
