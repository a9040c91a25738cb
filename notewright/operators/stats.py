"""Evaluation statistics as aggregations: perplexity, divergence, accuracy, intervals, throughput, pivots, build comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .joins import running

Z = 1.95996398454


def mean_stdev(d: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation (0 for a single row)."""
    return d.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"), F.count("*").alias("n"))


def throughput(tokens: Column, nanoseconds: Column) -> Column:
    """Tokens a second; infinite for no time, as IEEE division gives it."""
    return F.when(nanoseconds == 0, tokens * F.lit(float("inf"))).otherwise(1e9 * tokens / nanoseconds)


def perplexity(d: DataFrame, by: list[str], nll: str) -> DataFrame:
    """exp of the mean negative log-likelihood, with its error: sqrt((E[x^2] - E[x]^2) / (n - 1)) * ppl."""
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(nll).alias("m"), F.avg(F.col(nll) * F.col(nll)).alias("m2"))
    ppl = F.exp("m")
    err = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)) / (F.col("n") - 1)) * ppl).otherwise(F.lit(0.0))
    return s.select(*by, "n", ppl.alias("ppl"), err.alias("ppl_err"))


def strided_positions(d: DataFrame, by: list[str], order: str, n_ctx: int, stride: int) -> DataFrame:
    """Keeps the rows a strided evaluation scores: all of the first window's second half, then each window's stride tail."""
    r = d.withColumn("x_r", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    chunk = F.floor((F.col("x_r") - (n_ctx - stride)) / stride)
    return r.filter(F.col("x_r") >= n_ctx // 2).withColumn("chunk", F.greatest(chunk, F.lit(0)).cast("int")).drop("x_r")


def mean_and_error(n: Column, s: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and uncertainty from sums; the error is 0 up to 10 rows."""
    mean = s / n
    return F.when(n >= 1, mean).otherwise(0.0), F.when(n > 10, F.sqrt(F.greatest(s2 / n - mean * mean, F.lit(0.0)) / (n - 1))).otherwise(0.0)


#: Percentiles of the divergences that are reported.
KLD_POINTS = {"999": 0.999, "99": 0.99, "95": 0.95, "90": 0.9, "median": 0.5, "10": 0.1, "05": 0.05, "01": 0.01, "001": 0.001}


def divergence_suite(d: DataFrame, by: list[str], base_nll: str, nll: str, kld: str, same_top: str, least: int = 100) -> DataFrame:
    """Mean ratio of perplexities, correlation, KL mean / max / min / percentiles, probability shift and same-top rate in one pass, with errors.

    Percentiles and extremes are null for fewer than ``least`` rows.
    """
    b, q, k = F.col(base_nll), F.col(nll), F.col(kld)
    dp = F.exp(-q) - F.exp(-b)
    error = lambda x: F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0)) / (F.count("*") - 1))
    several = lambda x: F.when(F.count("*") > 1, x)
    enough = lambda x: F.when(F.count("*") >= least, x)
    top = F.col(same_top).cast("double")
    found = selection.percentiles(d, by, kld, list(KLD_POINTS.values())).drop("n").withColumnsRenamed({c: f"x_{c}" for c in by})
    s = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(b).alias("base_mean"), F.avg(q).alias("mean"), F.avg(q - b).alias("ln_ratio"), several(error(q - b)).alias("ln_ratio_err"), F.corr(b, q).alias("correlation"),
        F.avg(k).alias("kld_mean"), several(error(k)).alias("kld_err"), enough(F.max(k)).alias("kld_max"), enough(F.min(k)).alias("kld_min"), enough(F.lit(True)).alias("x_enough"),
        F.avg(dp).alias("dp_mean"), several(error(dp)).alias("dp_err"), F.sqrt(F.avg(dp * dp)).alias("dp_rms"), F.avg(top).alias("same_top"), F.coalesce(several(error(top)), F.lit(0.0)).alias("same_top_err"),
    )
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    s = s.join(found, on, "left")
    return s.select("*", *[F.when(F.col("x_enough"), F.get("points", F.lit(i))).alias(f"kld_{n}") for i, n in enumerate(KLD_POINTS)]).drop("points", "x_enough", *[f"x_{c}" for c in by])


def running_accuracy(d: DataFrame, by: list[str], order: str, correct: str) -> DataFrame:
    """Adds n, accuracy so far, and the Wilson interval's ends."""
    d = running(d, by, [order], {"n": F.lit(1).cast("long"), "x_right": F.col(correct).cast("long")})
    d = d.withColumn("accuracy", F.col("x_right") / F.col("n")).drop("x_right")
    lo, hi = wilson(F.col("accuracy"), F.col("n"))
    return d.withColumn("low", lo).withColumn("high", hi)


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return (mid - half) / (1 + Z * Z / n), (mid + half) / (1 + Z * Z / n)


def best_choice(d: DataFrame, task: list[str], choice: str, score: str) -> DataFrame:
    """Per task the choice with the highest score; the smaller choice on ties."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c"))).alias("x")
    return d.groupBy(*task).agg(top).select(*task, (-F.col("x.c")).alias(choice), F.col("x.s").alias(score))


def accuracy(d: DataFrame, by: list[str], correct: str) -> DataFrame:
    """Accuracy in percent with its error 100 * sqrt(p (1 - p) / (n - 1))."""
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("p"))
    return s.select(*by, "n", (100 * F.col("p")).alias("acc"), F.when(F.col("n") > 1, 100 * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") - 1))).otherwise(0.0).alias("err"))


def column_activity(d: DataFrame, by: list[str], values: str) -> DataFrame:
    """Importance matrix: per array position the sum of squares and the count."""
    x = d.select(*by, F.posexplode(values).alias("idx", "v"))
    return x.groupBy(*by, "idx").agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("sum_sq"), F.count("*").alias("n"))


def merge_activity(*parts: DataFrame) -> DataFrame:
    """Adds the sums and counts of several importance matrices."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    keys = [c for c in u.columns if c not in ("sum_sq", "n")]
    return u.groupBy(*keys).agg(F.sum("sum_sq").alias("sum_sq"), F.sum("n").alias("n"))


def compare_builds(d: DataFrame, keys: list[str], build: str, base: str, other: str, value: str) -> DataFrame:
    """Mean of ``value`` per key for two builds and their ratio, for keys that both have.

    Joining every pair of runs and averaging gives each run of a build equal weight within its key, so averaging first gives
    the same result and joins one row per key and build. Null keys match nothing, as in SQL.
    """
    m = d.filter(F.col(build).isin(base, other)).groupBy(*keys, build).agg(F.avg(value).alias("v"))
    b = m.filter(F.col(build) == base).drop(build).withColumnRenamed("v", "base")
    c = m.filter(F.col(build) == other).drop(build).withColumnRenamed("v", "other")
    return b.join(c, keys).withColumn("speedup", F.col("other") / F.col("base"))


def pass_ratio_pivot(d: DataFrame, row: str, column: str, values: list, passed: Column) -> DataFrame:
    """Share of passed runs, rows x columns; cells without runs are null."""
    return d.groupBy(row).pivot(column, values).agg(F.round(F.avg(passed.cast("double")), 6))


def parameter_grid(*options: DataFrame) -> DataFrame:
    """All combinations of option lists: small tables by intent."""
    out = options[0]
    for o in options[1:]:
        out = out.crossJoin(F.broadcast(o))
    return out


def power_iteration(gram: DataFrame, dim: int, rounds: int = 60) -> list[float]:
    """Leading eigenvector of a dim x dim matrix given as (i, j, v); the matrix, not the data, is on the driver."""
    import numpy as np

    m = np.zeros((dim, dim))
    for r in gram.collect():
        m[r["i"], r["j"]] = r["v"]
    v = np.ones(dim) / np.sqrt(dim)
    for _ in range(rounds):
        w = m @ v
        n = np.linalg.norm(w)
        if n == 0 or np.linalg.norm(w / n - v) < 1e-12:
            break
        v = w / n
    return v.tolist()
