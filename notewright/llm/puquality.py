"""Quality classifier by positive-unlabelled learning: trusted good documents against unlabelled web text, no labelled bad ones.

Features of a whole text: log rates of pairs of neighbouring character classes and of words, repetition and lines (``NAMES``),
standardised over all documents. The classifier is linear and minimises the non-negative unbiased risk of the logistic loss

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)]) + ridge,

E_p over the trusted positives and E_u over all unlabelled text (every row that isn't held out, whatever its label). While the
estimate of the negatives' risk is not negative the objective is convex, and Newton steps minimise it; a step into the negative
region, where the model would fit the positives' sampling noise, or one that raises the risk, is halved back, and the path ends at the boundary.
That early end leaves scores near one half, so margins are stretched by the one factor for which the mean score of unlabelled text is the
prior. Every step is one pass of sums over the stored features of all rows, added up by Spark; only the sums (the square of the features, in all)
reach the driver.

The class prior is estimated, not given: a plain positive-against-unlabelled model is fitted on one half of the rows (by hash), and histograms of its
scores over the other half bound the prior from above at every threshold by the share of unlabelled rows over that of positives, each with its
sampling error; the least bound is taken (best bin estimation).

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: neither their labels nor their texts are learned from. A null or empty text has
all rates 0 and is scored as such. A null doc_id is not held out and unlabelled. Repeated rows count and are scored each. A doc_id with
several labels is trusted if one says good. Without trusted positives every score is 0.5. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, store

#: Character classes: lower, upper, digit, blank, line break, sentence punctuation, other signs, beyond ASCII.
CLASSES = 8
_PAIRS = CLASSES * CLASSES
WORD_NAMES = ("log_words", "word_length", "distinct_words", "repeated_triples", "repeated_lines", "words_a_line", "letter_words", "capital_words", "sign_words", "longest_word")
NAMES = (*(f"pair_{i // CLASSES}{i % CLASSES}" for i in range(_PAIRS)), *WORD_NAMES)
D = len(NAMES)
_BLOCK = 1 << 20


def _class_table() -> np.ndarray:
    t = np.full(129, 6, dtype=np.int64)
    for c in range(128):
        s = chr(c)
        t[c] = 0 if s.islower() else 1 if s.isupper() else 2 if s.isdigit() else 4 if s == "\n" else 3 if s.isspace() else 5 if s in ".,;:!?'\"()-" else 6
    t[128] = 7
    return t


_CLASS = _class_table()


def features(text: str | None) -> np.ndarray:
    """The features in the order of NAMES. Character classes are taken in blocks, so a long text needs little more than itself."""
    text = text or ""
    x = np.zeros(D)
    if not text:
        return x
    pairs = np.zeros(_PAIRS, dtype=np.int64)
    last = None
    for i in range(0, len(text), _BLOCK):
        codes = _CLASS[np.minimum(np.frombuffer(text[i : i + _BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)]
        if last is not None:
            pairs[last * CLASSES + codes[0]] += 1
        pairs += np.bincount(codes[:-1] * CLASSES + codes[1:], minlength=_PAIRS)
        last = codes[-1]
    x[:_PAIRS] = np.log1p(1000.0 * pairs / len(text))
    words = text.split()
    n = len(words)
    if not n:
        return x
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    chars = sum(map(len, words))
    x[_PAIRS:] = [
        math.log1p(n), min(chars / n, 50.0), len(set(words)) / n, 1 - triples / (n - 2) if n > 2 else 0.0, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        sum(map(str.isalpha, words)) / n, sum(w.isupper() for w in words) / n, sum(not w[0].isalnum() for w in words) / n, math.log1p(max(map(len, words))),
    ]
    return x


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, trusted, half (0 or 1), x of every row; trusted rows have a label that says good and aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([features(t.as_py()) for t in b.column("text")]) if b.num_rows else np.zeros(0)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * D)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32)))], ["doc_id", "held_out", "x"])

    x = store(rows.mapInArrow(run, "doc_id long, held_out boolean, x array<float>"), "pu-features")
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    good = store(good.filter(~held_out()), "pu-trusted")
    # A null id would meet all others in one task of a shuffled join; it has no label, so it goes round it.
    out = x.filter("doc_id is not null").join(broadcast_if_small(good, 500_000), "doc_id", "left").unionByName(x.filter("doc_id is null"), allowMissingColumns=True)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    return out.select("doc_id", "held_out", F.coalesce("trusted", F.lit(False)).alias("trusted"), half.alias("half"), "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), D)


def _sum_over(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum of ``part(x, trusted)``, an array of ``size``, over all rows, added up by place in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column("x")), b.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    found = rows.select("x", "trusted").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and deviations of the features, and the number of rows."""
    s = _sum_over(rows, lambda x, p: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * D)
    n = max(s[0], 1.0)
    mean = s[1 : 1 + D] / n
    sd = np.sqrt(np.maximum(s[1 + D :] / n - mean * mean, 0))
    return mean, np.where(sd > 1e-6, sd, np.inf), int(s[0])


def design(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features, bounded at eight deviations, with a constant first."""
    return np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / sd, -8, 8)], axis=1)


_UPPER = np.triu_indices(D + 1)


def risk_sums(z: np.ndarray, trusted: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows: counts of all and trusted rows, their losses, gradients, and the curvature of the unlabelled loss.

    All rows are unlabelled text; trusted ones are positives besides. loss(m) = log(1 + exp(-m)).
    """
    g = z @ w
    s = 0.5 * (1 + np.tanh(g / 2))
    zp, gp, sp = z[trusted], g[trusted], s[trusted]
    curve = (z * (s * (1 - s))[:, None]).T @ z
    head = [len(z), len(zp), np.logaddexp(0, g).sum(), np.logaddexp(0, -gp).sum(), np.logaddexp(0, gp).sum()]
    return np.concatenate([head, s @ z, zp.sum(0), sp @ zp, curve[_UPPER]])


def _unpack(s: np.ndarray) -> dict:
    d = D + 1
    n, m = max(s[0], 1.0), max(s[1], 1.0)
    h = np.zeros((d, d))
    h[_UPPER] = s[5 + 3 * d :] / n
    return {
        "u_neg": s[2] / n, "p_pos": s[3] / m, "p_neg": s[4] / m, "gu": s[5 : 5 + d] / n, "zp": s[5 + d : 5 + 2 * d] / m, "gp": s[5 + 2 * d : 5 + 3 * d] / m,
        "h": h + np.triu(h, 1).T,
    }


def _minimise(sums, w: np.ndarray, objective, passes: int, ridge: float) -> tuple[np.ndarray, float, list[float]]:
    """Damped Newton steps: ``objective(stats)`` gives (risk, allowed, gradient, curvature) without the ridge."""
    penalty = np.full(D + 1, ridge)
    penalty[0] = 1e-6
    best, best_w, step, path, halved = math.inf, w, None, [], 0
    for _ in range(passes):
        risk, allowed, grad, curve = objective(_unpack(sums(w)))
        value = risk + 0.5 * float(penalty @ (w * w))
        if math.isfinite(best) and (not allowed or value > best + 1e-12):
            halved += 1
            if halved > 5:
                break
            step = step / 2
            w = best_w + step
            continue
        path.append(value)
        done, best, best_w, halved = best - value < 1e-7 * max(1.0, abs(value)), value, w, 0
        if done:
            break
        step = -np.linalg.solve(curve + np.diag(penalty), grad + penalty * w)
        w = best_w + step
    return best_w, best, path


def fit_risk(sums, prior: float, passes: int = 20, ridge: float = 1e-3) -> tuple[np.ndarray, float, list[float]]:
    """Weights of the least non-negative risk, that risk with its ridge, and the risks of the accepted steps."""

    def objective(s):
        negative = s["u_neg"] - prior * s["p_neg"]
        risk = prior * s["p_pos"] + max(0.0, negative)
        return risk, negative >= 0, s["gu"] - prior * s["zp"], s["h"]

    start = np.zeros(D + 1)
    return _minimise(sums, start, objective, passes, ridge)


def fit_plain(sums, passes: int = 8, ridge: float = 1e-2) -> np.ndarray:
    """Positives against unlabelled text, both weighing one half: only its order is used."""

    def objective(s):
        # The unlabelled curvature alone is a safe step: it bounds no other than itself, and steps that raise the loss are halved.
        return s["u_neg"] + s["p_pos"], True, s["gu"] - (s["zp"] - s["gp"]), 2 * s["h"]

    return _minimise(sums, np.zeros(D + 1), objective, passes, ridge)[0]


def best_bin(u: np.ndarray, p: np.ndarray, delta: float = 0.1) -> float:
    """The prior's least upper bound from histograms of scores (ascending) of unlabelled and positive rows."""
    nu, np_ = u.sum(), p.sum()
    if not nu or not np_:
        return 1.0
    qu, qp = (x[::-1].cumsum() / x.sum() for x in (u, p))
    slack = math.sqrt(math.log(4 / delta) / (2 * nu)) + math.sqrt(math.log(4 / delta) / (2 * np_))
    fit = qp > slack
    if not fit.any():
        return 1.0
    at = np.flatnonzero(fit)[np.argmin(((qu + slack) / np.where(fit, qp, 1))[fit])]
    return float(np.clip(qu[at] / qp[at], 0.05, 0.99))


BINS = 512
MARGINS, _MARGIN = 4_001, 0.01


def _margin_bin(g: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(g / _MARGIN).astype(int) + MARGINS // 2, 0, MARGINS - 1)


def stretch(margins: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """The factor of margins, 1/4 to 4, at which their mean score comes nearest the prior."""
    low, high = math.log(0.25), math.log(4.0)
    mean = lambda a: float(counts @ (0.5 * (1 + np.tanh(math.exp(a) * margins / 2)))) / max(counts.sum(), 1)
    rising = mean(high) >= mean(low)
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if (mean(mid) < prior) == rising else (low, mid)
    return math.exp(low)


def fit(rows: DataFrame, shrink: float = 32.0) -> dict | None:
    """mean, sd, prior and weights of the model over all of ``featured`` that isn't held out; null without positives.

    The ridge is ``shrink`` over the number of trusted rows.
    """
    seen = rows.filter(~F.col("held_out"))
    mean, sd, n = scale(seen)
    if not n:
        return None
    size = 5 + 3 * (D + 1) + len(_UPPER[0])
    made = lambda part: lambda w: _sum_over(part, lambda x, p: risk_sums(design(x, mean, sd), p, w), size)
    first = fit_plain(made(seen.filter("half = 0")))

    def bins(x, p):
        g = design(x, mean, sd) @ first
        at = np.clip((BINS * 0.5 * (1 + np.tanh(g / 2))).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[p], minlength=BINS)])

    counts = _sum_over(seen.filter("half = 1"), bins, 2 * BINS)
    if not counts[BINS:].any():
        return None
    prior = best_bin(counts[:BINS], counts[BINS:])
    trusted = seen.filter("trusted").count()
    w, risk, path = fit_risk(made(seen), prior, ridge=shrink / trusted)
    margins = _sum_over(seen, lambda x, p: np.bincount(_margin_bin(design(x, mean, sd) @ w), minlength=MARGINS), MARGINS)
    a = stretch((np.arange(MARGINS) - MARGINS // 2) * _MARGIN, margins, prior)
    return {"mean": mean, "sd": sd, "prior": prior, "w": a * w, "risk": risk, "path": path, "stretch": a}


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = store(featured(docs, labels), "pu-rows")
    model = fit(rows, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = 0.5 * (1 + np.tanh(design(_matrix(b.column("x")), model["mean"], model["sd"]) @ model["w"] / 2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s.round(9)), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
