"""Epochs of a distributed fit: gradients summed by Spark over all rows, one optimiser step each, state kept after every epoch.

A task multiplies its rows as one matrix and gives a sum for each weight; those are added up by place in partial aggregations, so that the driver
gets one row per weight. Rows are split into training and validation by a hash of their id, the same in every run. The state after an epoch (weights,
both moments, losses) is a table under its number; a fit that is started again goes on behind the last whole one, and gives what an uninterrupted one gives.

Rows with a null in id, features or target take no part. Without training rows the weights stay as they are and losses are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..streaming.count_tables import _whole


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums of the loss and of its gradient; the first weight is the constant's."""
    z = w[0] + x @ w[1:]
    r = 0.5 * (1 + np.tanh(z / 2)) - y
    return float(np.sum(np.logaddexp(0, z) - y * z)), np.concatenate([[r.sum()], r @ x])


def squared(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    r = w[0] + x @ w[1:] - y
    return float(np.sum(r * r)), 2 * np.concatenate([[r.sum()], r @ x])


LOSSES: dict[str, Callable] = {"logistic": logistic, "squared": squared}


@dataclass
class Fit:
    """Weights (the constant first), moments, and (epoch, training loss, validation loss) after each epoch; losses are those before the epoch's step."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    losses: list[tuple[int, float | None, float | None]] = field(default_factory=list)


def adamw(s: Fit, grad: np.ndarray, t: int, rate: float, decay: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
    s.m = b1 * s.m + (1 - b1) * grad
    s.v = b2 * s.v + (1 - b2) * grad * grad
    s.w = s.w * (1 - rate * decay) - rate * (s.m / (1 - b1**t)) / (np.sqrt(s.v / (1 - b2**t)) + eps)


def sgd(s: Fit, grad: np.ndarray, t: int, rate: float, decay: float) -> None:
    s.w = s.w - rate * (grad + decay * s.w)


STEPS: dict[str, Callable] = {"adamw": adamw, "sgd": sgd}


def gradient(rows: DataFrame, loss: str, w: np.ndarray) -> dict[bool, tuple[int, float, np.ndarray]]:
    """Of training rows (False) and validation rows (True): number, sum of losses, sum of gradients of (held, x, y)."""
    size, f = len(w) + 2, LOSSES[loss]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for b in batches:
            held, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("held", "y"))
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(w) - 1))
            for k in (0, 1):
                part = held.astype(bool) == bool(k)
                if part.any():
                    value, g = f(x[part], y[part], w)
                    total[k] += np.concatenate([[part.sum(), value], g])
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k == 1), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["held", "at", "v"])

    out = np.zeros((2, size))
    for r in rows.mapInArrow(run, "held boolean, at int, v double").groupBy("held", "at").agg(F.sum("v").alias("v")).collect():
        out[int(r["held"]), r["at"]] = r["v"]
    return {bool(k): (round(out[k, 0]), out[k, 1], out[k, 2:]) for k in (0, 1)}


def _resume(spark: SparkSession, path: str) -> tuple[int, Fit] | None:
    found = _whole(spark, path, "epoch=")
    if not found:
        return None
    last = max(found)
    rows = spark.read.parquet(found[last]).orderBy("at").collect()
    take = lambda c: np.array([r[c] for r in rows if r["epoch"] is None])
    return last, Fit(take("w"), take("m"), take("v"), [(r["epoch"], r["train"], r["valid"]) for r in rows if r["epoch"] is not None])


def _keep(spark: SparkSession, s: Fit, path: str, epoch: int) -> None:
    rows = [(i, float(w), float(m), float(v), None, None, None) for i, (w, m, v) in enumerate(zip(s.w, s.m, s.v, strict=True))]
    rows += [(len(s.w) + i, None, None, None, *x) for i, x in enumerate(s.losses)]
    d = spark.createDataFrame(rows, "at int, w double, m double, v double, epoch int, train double, valid double")
    d.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def fit(d: DataFrame, key: str, features: list[str], target: str, epochs: int, path: str | None = None, loss: str = "logistic", step: str = "adamw", rate: float = 0.1, decay: float = 0.0, valid_percent: int = 20) -> Fit:
    """Fits ``target`` on numeric ``features`` by ``epochs`` full passes; with ``path``, goes on behind the last epoch kept there."""
    spark = d.sparkSession
    x = d.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y"))
    x = x.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    rows = materialise(x.select((F.pmod(F.crc32(F.col("id").cast("string")), F.lit(100)) < valid_percent).alias("held"), "x", "y"), "fit-rows")
    zero = np.zeros(len(features) + 1)
    done, s = (path and _resume(spark, path)) or (0, Fit(zero.copy(), zero.copy(), zero.copy()))
    for epoch in range(done + 1, epochs + 1):
        got = gradient(rows, loss, s.w)
        (n, value, grad), (n_v, value_v, _) = got[False], got[True]
        s.losses.append((epoch, float(value / n) if n else None, float(value_v / n_v) if n_v else None))
        if n:
            STEPS[step](s, grad / n, epoch, rate, decay)
        if path:
            _keep(spark, s, path, epoch)
    return s


def predict(d: DataFrame, features: list[str], w: np.ndarray, loss: str = "logistic"):
    """The fitted value as a native Column."""
    z = F.lit(float(w[0]))
    for c, v in zip(features, w[1:], strict=True):
        z = z + F.col(c) * float(v)
    return 1 / (1 + F.exp(-z)) if loss == "logistic" else z


