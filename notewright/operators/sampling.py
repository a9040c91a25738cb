"""Candidate samplers as window programs over rows (ctx, id, logit).

Candidates of one context order by logit, highest first, then id. A sampler returns the surviving rows, with logits changed where it
changes them; ``softmax`` adds p. Masked candidates are dropped rows. Random draws come from md5(seed|ctx).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection

EPS = 1e-9


def _ctx():
    return Window.partitionBy("ctx")


def _ranked():
    return _ctx().orderBy(F.desc("logit"), "id")


def _running():
    return _ranked().rowsBetween(Window.unboundedPreceding, 0)


def chain(d: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Samplers one after the other."""
    for s in steps:
        d = s(d)
    return d


def softmax(d: DataFrame) -> DataFrame:
    d = d.withColumn("x_e", F.exp(F.col("logit") - F.max("logit").over(_ctx())))
    return d.withColumn("p", F.col("x_e") / F.sum("x_e").over(_ctx())).drop("x_e")


def _rank(d: DataFrame) -> DataFrame:
    return d.withColumn("x_r", F.row_number().over(_ranked()))


def greedy(d: DataFrame) -> DataFrame:
    return top_k(d, 1)


def top_k(d: DataFrame, k: int) -> DataFrame:
    """The k best; no-op for k <= 0. Only the rows from the bucket of the k-th on are ranked, so a context may be of any size."""
    return d if k <= 0 else _rank(selection.at_least_kth(d, "ctx", "logit", k)).filter(F.col("x_r") <= k).drop("x_r")


def top_p(d: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """Through the first candidate at which the running probability reaches p."""
    if p >= 1:
        return d
    d = _rank(softmax(d)).withColumn("x_c", F.sum("p").over(_running()) - F.col("p"))
    return d.filter((F.col("x_c") < p - EPS) | (F.col("x_r") <= max(1, min_keep))).drop("x_r", "x_c")


def min_p(d: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """Those with at least p times the best one's probability."""
    if p <= 0:
        return d
    d = _rank(d).withColumn("x_t", F.max("logit").over(_ctx()) + math.log(p))
    return d.filter((F.col("logit") >= F.col("x_t")) | (F.col("x_r") <= min_keep)).drop("x_r", "x_t")


def typical(d: DataFrame, p: float, min_keep: int = 1) -> DataFrame:
    """By distance of the surprise from the entropy, through the first candidate at which the running probability exceeds p."""
    if p >= 1:
        return d
    d = softmax(d)
    d = d.withColumn("x_h", F.sum(-F.col("p") * F.log("p")).over(_ctx())).withColumn("x_s", F.round(F.abs(-F.log("p") - F.col("x_h")), 12))
    w = _ctx().orderBy("x_s", F.desc("logit"), "id")
    d = d.withColumn("x_r", F.row_number().over(w)).withColumn("x_c", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("p"))
    return d.filter((F.col("x_c") <= p + EPS) | (F.col("x_r") <= max(1, min_keep))).drop("x_h", "x_s", "x_r", "x_c")


def temperature(d: DataFrame, t: float) -> DataFrame:
    """Logits over t; for t <= 0 the best alone."""
    return greedy(d) if t <= 0 else d.withColumn("logit", F.col("logit") / t)


def temperature_dynamic(d: DataFrame, t: float, delta: float, exponent: float = 1.0) -> DataFrame:
    """Temperature between t - delta and t + delta by the normalised entropy; a single candidate stays."""
    if delta <= 0:
        return temperature(d, t)
    low, high = max(0.0, t - delta), t + delta
    d = softmax(d).withColumn("x_n", F.count("*").over(_ctx())).withColumn("x_h", F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).over(_ctx()))
    norm = F.greatest(F.col("x_h") / F.log(F.col("x_n")), F.lit(0.0))
    new = F.when(F.col("x_n") > 1, F.col("logit") / (low + (high - low) * F.pow(norm, F.lit(exponent)))).otherwise(F.col("logit"))
    return d.withColumn("logit", new).drop("x_n", "x_h", "p")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(seed|keys)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / 4294967296.0


def dist(d: DataFrame, seed: str) -> DataFrame:
    """One candidate per context, drawn by probability."""
    d = softmax(d).withColumn("x_c", F.sum("p").over(_running())).withColumn("x_u", uniform(seed, F.col("ctx")))
    d = d.withColumn("x_l", F.max("x_c").over(_ctx())).filter(F.col("x_c") > F.least(F.col("x_u"), F.col("x_l") - EPS))
    return _rank(d).filter("x_r = 1").drop("x_c", "x_u", "x_l", "x_r")


def xtc(d: DataFrame, probability: float, threshold: float, min_keep: int = 0, seed: str = "xtc") -> DataFrame:
    """With ``probability`` per context drops all candidates above the threshold but the last of them."""
    if probability <= 0 or threshold > 0.5:
        return d
    d = _rank(softmax(d)).withColumn("x_a", F.sum((F.col("p") >= threshold).cast("int")).over(_ctx())).withColumn("x_n", F.count("*").over(_ctx()))
    act = (uniform(seed, F.col("ctx")) <= probability) & (F.col("x_a") > 1) & (F.col("x_n") - F.col("x_a") >= min_keep)
    return d.filter(~act | (F.col("x_r") >= F.col("x_a"))).drop("x_r", "x_a", "x_n")


def top_n_sigma(d: DataFrame, n: float) -> DataFrame:
    """Those within n population standard deviations of the best logit; no-op for n <= 0."""
    if n <= 0:
        return d
    d = d.withColumn("x_t", F.max("logit").over(_ctx()) - n * F.stddev_pop("logit").over(_ctx()))
    return d.filter(F.col("logit") >= F.col("x_t")).drop("x_t")


def penalties(d: DataFrame, history: DataFrame, last_n: int, repeat: float = 1.0, freq: float = 0.0, present: float = 0.0) -> DataFrame:
    """Lowers candidates by their count among the context's last ``last_n`` tokens; history is (ctx, pos, id)."""
    h = history.withColumn("x_r", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("pos")))).filter(F.col("x_r") <= last_n)
    n = h.groupBy("ctx", "id").agg(F.count("*").alias("x_n"))
    d = d.join(n, ["ctx", "id"], "left")
    scaled = F.when(F.col("logit") <= 0, F.col("logit") * repeat).otherwise(F.col("logit") / repeat)
    return d.withColumn("logit", F.when(F.col("x_n") > 0, scaled - F.col("x_n") * freq - present).otherwise(F.col("logit"))).drop("x_n")


def logit_bias(d: DataFrame, bias: DataFrame) -> DataFrame:
    """Adds the bias of (id, bias)."""
    return d.join(bias, "id", "left").withColumn("logit", F.col("logit") + F.coalesce("bias", F.lit(0.0))).drop("bias")


def ranked_report(d: DataFrame, n: int) -> DataFrame:
    """The n most probable candidates of each context with rank and p."""
    return softmax(d).withColumn("rank", F.row_number().over(_ranked())).filter(F.col("rank") <= n)


def repeat_lengths(tokens: list[int], breakers: frozenset[int], last_n: int) -> dict[int, int]:
    """For each token that would continue a repetition of the sequence's end: the longest such repetition.

    The lengths are the common prefixes of the reversed sequence with its own endings (its Z values), linear in the sequence.
    """
    t = (tokens[-last_n:] if last_n > 0 else tokens)[::-1]
    most = next((i for i, x in enumerate(t) if x in breakers), len(t))
    z, left, right, out = [0] * len(t), 0, 0, {}
    for i in range(1, len(t)):
        n = min(right - i, z[i - left]) if i < right else 0
        while i + n < len(t) and t[n] == t[i + n]:
            n += 1
        z[i] = n
        if i + n > right:
            left, right = i, i + n
        if min(n, most):
            out[t[i - 1]] = max(min(n, most), out.get(t[i - 1], 0))
    return out


def dry(d: DataFrame, history: DataFrame, multiplier: float, base: float = 1.75, allowed: int = 2, last_n: int = -1, breakers: frozenset[int] = frozenset()) -> DataFrame:
    """Lowers the tokens that would prolong a repetition of at least ``allowed`` tokens, exponentially in its length.

    The repetitions are found per context from its history (ctx, pos, id), which is sequential and so runs in pandas.
    """

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values("pos")["id"].tolist()
        cuts = [(k, multiplier * base ** (n - allowed)) for k, n in repeat_lengths(t, breakers, last_n).items() if n >= allowed]
        return pd.DataFrame({"ctx": [pdf["ctx"].iloc[0]] * len(cuts), "id": [k for k, _ in cuts], "x_cut": [c for _, c in cuts]})

    kind = dict(history.dtypes)
    cuts = history.groupBy("ctx").applyInPandas(find, f"ctx {kind['ctx']}, id {kind['id']}, x_cut double")
    return d.join(cuts, ["ctx", "id"], "left").withColumn("logit", F.col("logit") - F.coalesce("x_cut", F.lit(0.0))).drop("x_cut")


def mirostat_v2(steps: DataFrame, tau: float, eta: float, seed: str = "mirostat") -> DataFrame:
    """(ctx, step, id, mu): one draw per step with surprise at most mu, which follows the surprise of the draws.

    ``steps`` is (ctx, step, id, logit); mu is state along a context's steps.
    """
    import hashlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, out = 2 * tau, []
        for step, g in pdf.sort_values(["step", "logit", "id"], ascending=[True, False, True]).groupby("step", sort=True):
            e = (g["logit"] - g["logit"].max()).map(math.exp)
            p = e / e.sum()
            keep = max(1, int((-p.map(math.log2) <= mu).sum()))
            q = p.iloc[:keep] / p.iloc[:keep].sum()
            u = int(hashlib.md5(f"{seed}|{g['ctx'].iloc[0]}|{step}".encode()).hexdigest()[:8], 16) / 2**32
            at = min(int((q.cumsum() <= u).sum()), keep - 1)
            mu -= eta * (-math.log2(q.iloc[at]) - tau)
            out.append((g["ctx"].iloc[0], step, g["id"].iloc[at], mu))
        return pd.DataFrame(out, columns=["ctx", "step", "id", "mu"])

    kind = dict(steps.dtypes)
    return steps.groupBy("ctx").applyInPandas(run, f"ctx {kind['ctx']}, step {kind['step']}, id {kind['id']}, mu double")


def mirostat(steps: DataFrame, tau: float, eta: float, m: int = 100, n_vocab: int = 32_000, seed: str = "mirostat") -> DataFrame:
    """As mirostat_v2, with a cut to k candidates, k from the Zipf exponent of the m best."""
    import hashlib

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, out = 2 * tau, []
        for step, g in pdf.sort_values(["step", "logit", "id"], ascending=[True, False, True]).groupby("step", sort=True):
            e = (g["logit"] - g["logit"].max()).map(math.exp)
            p = (e / e.sum()).tolist()
            pairs = [(math.log((i + 2) / (i + 1)), math.log(p[i] / p[i + 1])) for i in range(min(m, len(p)) - 1) if p[i + 1] > 0]
            s = sum(t * b for t, b in pairs) / (sum(t * t for t, _ in pairs) or 1.0)
            eps = s - 1
            k = ((eps * 2**mu) / (1 - n_vocab**-eps)) ** (1 / s) if s > 0 and abs(eps) > 1e-12 else len(p)
            keep = max(1, min(len(p), int(k)))
            total = sum(p[:keep])
            u = int(hashlib.md5(f"{seed}|{g['ctx'].iloc[0]}|{step}".encode()).hexdigest()[:8], 16) / 2**32
            run_sum, at = 0.0, keep - 1
            for i in range(keep):
                run_sum += p[i] / total
                if run_sum > u:
                    at = i
                    break
            mu -= eta * (-math.log2(p[at] / total) - tau)
            out.append((g["ctx"].iloc[0], step, g["id"].iloc[at], mu))
        return pd.DataFrame(out, columns=["ctx", "step", "id", "mu"])

    kind = dict(steps.dtypes)
    return steps.groupBy("ctx").applyInPandas(run, f"ctx {kind['ctx']}, step {kind['step']}, id {kind['id']}, mu double")
