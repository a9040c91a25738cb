"""Sampler chains from parameters, the fill-in-the-middle sampler, and statistics of training runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling as S


@dataclass(frozen=True)
class SamplerParams:
    """Parameters of a chain; the defaults are fixed values that must equal the usual ones."""

    seed: str = "dist"
    samplers: tuple[str, ...] = ("penalties", "dry", "top_n_sigma", "top_k", "typical", "top_p", "min_p", "xtc", "temperature")
    min_keep: int = 0
    top_k: int = 40
    top_p: float = 0.95
    min_p: float = 0.05
    typical: float = 1.0
    temp: float = 0.8
    dynatemp_range: float = 0.0
    dynatemp_exponent: float = 1.0
    xtc_probability: float = 0.0
    xtc_threshold: float = 0.1
    top_n_sigma: float = -1.0
    penalty_last_n: int = 64
    penalty_repeat: float = 1.0
    penalty_freq: float = 0.0
    penalty_present: float = 0.0
    dry_multiplier: float = 0.0
    dry_base: float = 1.75
    dry_allowed: int = 2
    dry_last_n: int = -1
    dry_breakers: frozenset[int] = field(default_factory=frozenset)


Step = Callable[[DataFrame], DataFrame]


def assemble(p: SamplerParams, history: DataFrame | None = None, bias: DataFrame | None = None, pieces: DataFrame | None = None) -> list[Step]:
    """The steps of a chain: the logit bias, the named samplers in their order, and one draw.

    Samplers that need a history (penalties, dry) or the pieces of tokens (infill) are left out where they have none or change nothing.
    """
    known: dict[str, Step | None] = {
        "top_k": lambda d: S.top_k(d, p.top_k), "top_p": lambda d: S.top_p(d, p.top_p, max(1, p.min_keep)), "min_p": lambda d: S.min_p(d, p.min_p, max(1, p.min_keep)),
        "typical": lambda d: S.typical(d, p.typical, max(1, p.min_keep)), "top_n_sigma": lambda d: S.top_n_sigma(d, p.top_n_sigma),
        "xtc": lambda d: S.xtc(d, p.xtc_probability, p.xtc_threshold, p.min_keep, p.seed),
        "temperature": lambda d: S.temperature_dynamic(d, p.temp, p.dynatemp_range, p.dynatemp_exponent),
        "penalties": None, "dry": None, "infill": None,
    }
    if history is not None and p.penalty_last_n and (p.penalty_repeat != 1.0 or p.penalty_freq or p.penalty_present):
        known["penalties"] = lambda d: S.penalties(d, history, p.penalty_last_n, p.penalty_repeat, p.penalty_freq, p.penalty_present)
    if history is not None and p.dry_multiplier:
        known["dry"] = lambda d: S.dry(d, history, p.dry_multiplier, p.dry_base, p.dry_allowed, p.dry_last_n, p.dry_breakers)
    if pieces is not None:
        known["infill"] = lambda d: infill(d, pieces)
    unknown = [n for n in p.samplers if n not in known]
    if unknown:
        raise ValueError(f"unknown samplers: {unknown}")
    steps = [lambda d: S.logit_bias(d, bias)] if bias is not None else []
    return steps + [known[n] for n in p.samplers if known[n] is not None] + [lambda d: S.dist(d, p.seed)]


def fill_in(rows: list[tuple[int, str, float, bool]]) -> list[tuple[int, float]]:
    """(id, p) of what stays of one context's candidates (id, piece, p, ends), given by descending p.

    Where ending is likely enough (three times its mass times the candidates outweighs the text's), only ends stay. Else candidates whose
    text begins another's are joined into the likelier of the two; then those under 0.2, and after rescaling those under
    1 / (texts left + 1), go, ends excepted. Without a text left the first end stays alone.
    """
    ends = sum(p for _, _, p, e in rows if e)
    if 3 * ends * len(rows) > sum(p for _, _, p, e in rows if not e):
        return [(i, p / ends) for i, _, p, e in rows if e]
    mass = [p for _, _, p, _ in rows]
    gone = [False] * len(rows)
    by_text: dict[str, list[int]] = {}
    for n, (_, piece, _, _) in enumerate(rows):
        for k in range(1, len(piece) + 1):
            by_text.setdefault(piece[:k], []).append(n)
    for a, (_, piece, _, _) in enumerate(rows):
        for b in by_text.get(piece, []) if piece else []:
            if gone[a]:
                break
            if a == b or gone[b]:
                continue
            keep, lose = (b, a) if mass[b] > mass[a] else (a, b)
            mass[keep] += mass[lose]
            mass[lose], gone[lose] = 0.0, True
    left = [n for n, r in enumerate(rows) if mass[n] >= 0.2 or r[3]]
    texts = sum(not rows[n][3] for n in left)
    if not texts:
        return [(next((r[0] for r in rows if r[3]), rows[0][0]), 1.0)]
    total = sum(mass[n] for n in left)
    left = [n for n in left if mass[n] / total >= 1 / (texts + 1) or rows[n][3]]
    total = sum(mass[n] for n in left)
    return [(rows[n][0], mass[n] / total) for n in left]


def infill(d: DataFrame, pieces: DataFrame) -> DataFrame:
    """Fill-in-the-middle sampler on (ctx, id, logit) with pieces (id, piece, ends); logits become those of the new probabilities.

    Joining prefixes goes by falling probability, so a context's candidates (a vocabulary at most) meet in one task.
    """
    x = S.softmax(d).join(F.broadcast(pieces) if pieces.limit(500_001).count() <= 500_000 else pieces, "id").select("ctx", "id", "piece", "p", "ends")
    kind = dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "id"], ascending=[False, True])
        kept = fill_in(list(zip(pdf["id"].tolist(), pdf["piece"].tolist(), pdf["p"].tolist(), pdf["ends"].tolist(), strict=True)))
        return pd.DataFrame({"ctx": [pdf["ctx"].iloc[0]] * len(kept), "id": [i for i, _ in kept], "p": [p for _, p in kept]})

    out = x.groupBy("ctx").applyInPandas(run, f"ctx {kind['ctx']}, id {kind['id']}, p double")
    return out.filter("p > 0").select("ctx", "id", F.log("p").alias("logit"))


def training_result(d: DataFrame, by: list[str], loss: str, correct: str, rows: str, per_row: bool = True) -> DataFrame:
    """Loss and accuracy of a run with their uncertainties from its batches (loss, correct answers, rows).

    A loss per row is the mean over batches with error sqrt(var / (n - 1)), else the sum with sqrt(var n / (n - 1)); null below two batches or rows.
    """
    x = F.col(loss)
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("s2"), F.sum(correct).alias("c"), F.sum(rows).alias("r"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    spread = var / (F.col("n") - 1) if per_row else var * F.col("n") / (F.col("n") - 1)
    acc = F.col("c") / F.col("r")
    return s.select(
        *by, F.col("r").alias("rows"), (mean if per_row else F.col("s")).alias("loss"), F.when(F.col("n") > 1, F.sqrt(spread)).alias("loss_err"),
        acc.alias("accuracy"), F.when(F.col("r") > 1, F.sqrt(acc * (1 - acc) / (F.col("r") - 1))).alias("accuracy_err"),
    )


def mean_covariance(a: str, b: str) -> Column:
    """Covariance of two means: (E[ab] - E[a] E[b]) / (n - 1); null up to ten rows."""
    n = F.count("*")
    return F.when(n > 10, (F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)) / (n - 1))


def epoch_batches(d: DataFrame, key: str, seed: str, batch: int, validation: float) -> DataFrame:
    """Adds split (train or validation) and batch of a seeded shuffle of the rows.

    The order is by md5(seed|key) within 1,024 ranges of that hash, whose sizes shift the places, so no task ranks the whole table.
    """
    from pyspark.sql import Window

    d = d.withColumn("x_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    d = d.withColumn("split", F.when(F.conv(F.substring("x_h", 1, 8), 16, 10).cast("double") < validation * 2**32, "validation").otherwise("train"))
    d = d.withColumn("x_b", F.conv(F.substring("x_h", 1, 3), 16, 10).cast("int") % 4096)
    sizes = d.groupBy("split", "x_b").agg(F.count("*").alias("x_n"))
    before = F.sum("x_n").over(Window.partitionBy("split").orderBy("x_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("split", "x_b", F.coalesce(before, F.lit(0)).alias("x_o"))  # 4,096 rows a split
    d = d.withColumn("x_r", F.row_number().over(Window.partitionBy("split", "x_b").orderBy("x_h", key)))
    d = d.join(F.broadcast(sizes), ["split", "x_b"])
    return d.withColumn("batch", F.floor((F.col("x_r") + F.col("x_o") - 1) / batch)).drop("x_h", "x_b", "x_r", "x_o")
