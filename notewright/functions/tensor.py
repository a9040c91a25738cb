"""Tensor operators on rows: dim 0 is an array column, further dims are key columns; sparse operators use rows (i, j, v).

Accumulation is in double. Everything here is a Column or DataFrame expression but gelu_erf and the recurrences, which are sequential.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from . import blocks, scans

SQRT_2_PI = 0.79788456080286535587989211986876

#: Elementwise functions of one value.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "sgn": F.signum,
    "neg": lambda x: -x,
    "step": lambda x: F.when(x > 0, 1.0).otherwise(0.0),
    "tanh": F.tanh,
    "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(SQRT_2_PI * x * (1 + 0.044715 * x * x))),
    "gelu_quick": lambda x: x / (1 + F.exp(-1.702 * x)),
    "silu": lambda x: x / (1 + F.exp(-x)),
    "hardswish": lambda x: x * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)),
    "hardsigmoid": lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x + 3) / 6)),
    "exp": F.exp,
    "sqr": lambda x: x * x,
    "sqrt": F.sqrt,
    "log": F.log,
    "sin": F.sin,
    "cos": F.cos,
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once per row; inside ``transform`` it would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Rows up to which a kernel or table of offsets is broadcast.
SMALL = 100_000


def small(d: DataFrame, rows: int = SMALL) -> DataFrame:
    """Broadcasts ``d`` if it has at most ``rows`` rows; the count stops one row beyond that."""
    return F.broadcast(d) if d.limit(rows + 1).count() <= rows else d


def double(a: Column) -> Column:
    return a.cast("array<double>")


def unary(a: Column, op: str) -> Column:
    return F.transform(a, UNARY[op])


@pandas_udf(ArrayType(DoubleType()))
def gelu_erf(a: pd.Series) -> pd.Series:
    """Exact GELU; there is no built-in error function."""
    return a.map(lambda v: None if v is None else [0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in v])


def leaky_relu(a: Column, slope: float) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x).otherwise(slope * x))


def binary(a: Column, b: Column, op: str) -> Column:
    """add, sub, mul, div; ``b`` tiles into ``a``. Division by zero gives null."""
    f = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.try_divide(x, y)}[op]
    return F.transform(a, lambda x, i: f(x, F.get(b, i % F.size(b))))


def scale(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: x * s)


def add1(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x + s)


def clamp(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sum_rows(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_rows(a: Column) -> Column:
    return sum_rows(a) / F.size(a)


def argmax(a: Column) -> Column:
    """Index (from 0) of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def count_equal(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("long")


def norm(a: Column, eps: float = 1e-5) -> Column:
    def centred(m: Column) -> Column:
        sd = F.sqrt(mean_rows(F.transform(a, lambda x: (x - m) * (x - m))) + eps)
        return let(sd, lambda s: F.transform(a, lambda x: (x - m) / s))

    return let(mean_rows(a), centred)


def rms_norm(a: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(mean_rows(F.transform(a, lambda x: x * x)) + eps), lambda r: F.transform(a, lambda x: x / r))


def l2_norm(a: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(F.sqrt(sum_rows(F.transform(a, lambda x: x * x))), F.lit(eps)), lambda r: F.transform(a, lambda x: x / r))


def group_norm(a: Column, groups: int, eps: float = 1e-5) -> Column:
    """Norm over equal contiguous groups of the row."""
    n = (F.size(a) / groups).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: let(F.slice(a, g * n + 1, n), lambda part: norm(part, eps))))


def soft_max(a: Column, s: float = 1.0, mask: Column | None = None, slope: float = 1.0) -> Column:
    """softmax(s * a + slope * mask); null mask values take no part and come out as 0 (all null if none takes part)."""
    x = F.transform(a, lambda v: v * s) if mask is None else F.zip_with(a, mask, lambda v, m: v * s + slope * m)
    e = let(x, lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0)))))
    return let(e, lambda y: let(sum_rows(y), lambda t: F.transform(y, lambda v: F.try_divide(v, t))))


def soft_max_back(grad: Column, y: Column, s: float = 1.0) -> Column:
    total = sum_rows(F.zip_with(grad, y, lambda g, v: g * v))
    return let(total, lambda t: F.zip_with(grad, y, lambda g, v: s * v * (g - t)))


def silu_back(grad: Column, x: Column) -> Column:
    sig = lambda v: 1 / (1 + F.exp(-v))
    return F.zip_with(grad, x, lambda g, v: g * sig(v) * (1 + v * (1 - sig(v))))


def rms_norm_back(grad: Column, x: Column, eps: float = 1e-5) -> Column:
    n = F.size(x)
    sums = F.struct(sum_rows(F.transform(x, lambda v: v * v)).alias("ss"), sum_rows(F.zip_with(x, grad, lambda v, g: v * g)).alias("xg"))
    return let(sums, lambda t: F.zip_with(x, grad, lambda v, g: (g - v * t["xg"] / (t["ss"] + eps * n)) / F.sqrt(t["ss"] / n + eps)))


def log_soft_max(a: Column) -> Column:
    def minus(top: Column) -> Column:
        return let(top + F.log(sum_rows(F.transform(a, lambda v: F.exp(v - top)))), lambda lse: F.transform(a, lambda v: v - lse))

    return let(F.array_max(a), minus)


def cross_entropy(a: Column, b: Column) -> Column:
    """-sum of log_softmax(a) * b of one row; the loss is its mean over rows."""
    return -sum_rows(F.zip_with(log_soft_max(a), b, lambda x, y: x * y))


def cross_entropy_back(a: Column, b: Column, grad: Column, n_rows: Column) -> Column:
    return F.zip_with(soft_max(a), b, lambda p, y: (p - y) * grad / n_rows)


def adamw(x: Column, g: Column, m: Column, v: Column, step: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, wd: float = 0.0) -> Column:
    """array<struct<x, m, v>> after one step with decoupled weight decay."""
    h1, h2 = 1 / (1 - b1**step), 1 / (1 - b2**step)

    def one(i):
        gi = F.get(g, i)
        mi, vi = F.get(m, i) * b1 + gi * (1 - b1), F.get(v, i) * b2 + gi * gi * (1 - b2)
        return F.struct((F.get(x, i) * (1 - lr * wd) - lr * mi * h1 / (F.sqrt(vi * h2) + eps)).alias("x"), mi.alias("m"), vi.alias("v"))

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), one)


# Layout


def repeat(a: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(a, times))


def repeat_back(a: Column, n: int) -> Column:
    """Sums the tiles of length n."""
    tiles = (F.size(a) / n).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.transform(F.sequence(F.lit(0), tiles), lambda t: F.get(a, t * n + i)), F.lit(0.0), lambda s, x: s + x))


def view(a: Column, offset: int, n: int) -> Column:
    return F.slice(a, offset + 1, n)


def set_view(a: Column, b: Column, offset: int) -> Column:
    return F.concat(F.slice(a, 1, offset), b, F.slice(a, F.size(b) + offset + 1, F.size(a)))


def acc_view(a: Column, b: Column, offset: int) -> Column:
    return set_view(a, F.zip_with(F.slice(a, offset + 1, F.size(b)), b, lambda x, y: x + y), offset)


def pad(a: Column, n: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), n))


def pad_reflect(a: Column, left: int, right: int) -> Column:
    return F.concat(F.reverse(F.slice(a, 2, left)), a, F.reverse(F.slice(a, F.size(a) - right, right)))


def arange(start: float, stop: float, step: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(math.ceil((stop - start) / step) - 1)), lambda i: start + i * step)


def timestep_embedding(t: Column, dim: int, max_period: float = 10_000.0) -> Column:
    half = dim // 2
    freq = lambda i: t * F.exp(-math.log(max_period) * i / half)
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    out = F.concat(F.transform(steps, lambda i: F.cos(freq(i))), F.transform(steps, lambda i: F.sin(freq(i))))
    return out if dim % 2 == 0 else F.concat(out, F.array(F.lit(0.0)))


def argsort(a: Column, descending: bool = False) -> Column:
    """Indices (from 0) that sort the row; ties by index."""
    pairs = F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def top_k(a: Column, k: int) -> Column:
    return F.slice(argsort(a, True), 1, k)


def pool_1d(a: Column, k: int, stride: int, kind: str = "avg") -> Column:
    n = F.floor((F.size(a) - k) / stride).cast("int")
    part = lambda i: F.slice(a, i * stride + 1, k)
    return F.transform(F.sequence(F.lit(0), n), lambda i: mean_rows(part(i)) if kind == "avg" else F.array_max(part(i)))


def upscale(a: Column, factor: int) -> Column:
    """Nearest neighbour."""
    return F.transform(F.sequence(F.lit(0), F.size(a) * factor - 1), lambda i: F.get(a, F.floor(i / factor).cast("int")))


def upscale_linear(a: Column, factor: int) -> Column:
    """Linear interpolation between pixel centres."""
    at = lambda i: F.greatest((i + 0.5) / factor - 0.5, F.lit(0.0))
    low = lambda i: F.floor(at(i)).cast("int")
    high = lambda i: F.least(low(i) + 1, F.size(a) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(a) * factor - 1), lambda i: F.get(a, low(i)) * (1 - (at(i) - low(i))) + F.get(a, high(i)) * (at(i) - low(i)))


def im2col_1d(a: Column, k: int, stride: int = 1, padding: int = 0, dilation: int = 1) -> Column:
    """Patches of length k, one array per output place."""
    z = F.concat(F.array_repeat(F.lit(0.0), padding), a, F.array_repeat(F.lit(0.0), padding))
    n = F.floor((F.size(a) + 2 * padding - dilation * (k - 1) - 1) / stride).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda o: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get(z, o * stride + j * dilation)))


def conv_1d(a: Column, kernel: Column, k: int, stride: int = 1, padding: int = 0, dilation: int = 1) -> Column:
    return F.transform(im2col_1d(a, k, stride, padding, dilation), lambda p: dot(p, kernel))


def conv_transpose_1d(a: Column, kernel: Column, k: int, stride: int = 1) -> Column:
    n = (F.size(a) - 1) * stride + k
    term = lambda o, j: F.when(((o - j) % stride == 0) & (o - j >= 0), F.coalesce(F.get(a, F.floor((o - j) / stride).cast("int")), F.lit(0.0)) * F.get(kernel, j)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: term(o, j)), F.lit(0.0), lambda s, x: s + x))


def rope(a: Column, pos: Column, n_dims: int, neox: bool = False, base: float = 10_000.0, freq_scale: float = 1.0, back: bool = False) -> Column:
    """Rotates pairs of the first n_dims values by the position's angles: neighbours, or halves with ``neox``; ``back`` undoes it."""
    half, sign = n_dims // 2, -1.0 if back else 1.0

    def one(i):
        pair = (i % half) if neox else F.floor(i / 2).cast("int")
        angle = pos * freq_scale * F.pow(F.lit(base), -2.0 * pair / n_dims)
        first = (i < half) if neox else (i % 2 == 0)
        x0, x1 = (F.get(a, pair), F.get(a, pair + half)) if neox else (F.get(a, pair * 2), F.get(a, pair * 2 + 1))
        turned = F.when(first, x0 * F.cos(angle) - sign * x1 * F.sin(angle)).otherwise(sign * x0 * F.sin(angle) + x1 * F.cos(angle))
        return F.when(i < n_dims, turned).otherwise(F.get(a, i))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)


def dot(a: Column, b: Column) -> Column:
    return sum_rows(F.zip_with(a, b, lambda x, y: x * y))


def diag_mask(a: Column, row: Column, n_past: int, value: Column) -> Column:
    """Values behind the diagonal (j > n_past + row) become ``value``; null stands for minus infinity."""
    return F.transform(a, lambda x, j: F.when(j > row + n_past, value).otherwise(x))


# Rows (i, j, v)


def to_coo(d: DataFrame, key: str, a: str) -> DataFrame:
    return d.select(F.col(key).alias("i"), F.posexplode(a).alias("j", "v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mul_mat(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, k, v): contraction over the shared dim 0 (j) of rows i of a and rows i of b, by tiles (``blocks.product``)."""
    return blocks.product(a, b.withColumnRenamed("i", "k"), "j", "i", "k")


def gram(d: DataFrame, a: str, dim: int) -> DataFrame:
    """(i, j, v) of the dim x dim matrix of products of columns: each task multiplies its rows as one matrix, and the tasks' sums are added.

    A null row, or one of another length, takes no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = np.asarray(b.column(0).flatten(), dtype=np.float64).reshape(-1, dim)
            total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim, dtype=np.int32), np.int32(dim))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "v"])

    whole = d.filter((F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull())).select(F.col(a).cast("array<double>").alias(a))
    return whole.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def mul_mat_id(experts: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, e, i, v): each row times the matrices that its ids name, one product of tiles per expert; experts (e, i, j, v), b (row, j, v), ids (row, e).

    A row that names an expert twice counts once.
    """
    routed = ids.select("row", "e").distinct().join(b.select("row", "j", "v"), "row")
    return blocks.product(experts, routed, "j", "i", "row", ["e"]).select("row", "e", "i", "v")


def get_rows(d: DataFrame, ids: DataFrame, key: str, id_column: str) -> DataFrame:
    """Rows of ``d`` by id, once for each row of ``ids``."""
    return ids.join(d, ids[id_column] == d[key])


def get_rows_back(grads: DataFrame, id_column: str, a: str) -> DataFrame:
    """Adds the gradient rows into their ids: (id, idx, v)."""
    return grads.select(id_column, F.posexplode(a).alias("idx", "x_v")).groupBy(id_column, "idx").agg(F.sum("x_v").alias("v"))


def pool_2d(m: DataFrame, k0: int, k1: int, s0: int, s1: int, kind: str = "avg", p0: int = 0, p1: int = 0) -> DataFrame:
    """(i, j, v) of the windows; a cell goes to the windows that cover it."""
    outs = lambda c, k, s, p: F.sequence(F.greatest(F.ceil((F.col(c) + p - k + 1) / s).cast("int"), F.lit(0)), F.floor((F.col(c) + p) / s).cast("int"))
    x = m.select("v", F.explode(outs("i", k1, s1, p1)).alias("oi"), "j").select("v", "oi", F.explode(outs("j", k0, s0, p0)).alias("oj"))
    g = x.groupBy("oi", "oj").agg((F.sum("v") / (k0 * k1) if kind == "avg" else F.max("v")).alias("v"), F.count("*").alias("x_n"))
    full = g if p0 or p1 else g.filter(F.col("x_n") == k0 * k1)
    return full.select(F.col("oi").alias("i"), F.col("oj").alias("j"), "v")


def conv_2d_dw(m: DataFrame, kernel: DataFrame) -> DataFrame:
    """Valid depth-wise convolution, stride 1: m (c, i, j, v), kernel (c, di, dj, w)."""
    x = m.join(small(kernel), "c").select("c", (F.col("i") - F.col("di")).alias("i"), (F.col("j") - F.col("dj")).alias("j"), (F.col("v") * F.col("w")).alias("v"))
    n = kernel.groupBy("c").agg(F.count("*").alias("x_k"))
    g = x.groupBy("c", "i", "j").agg(F.sum("v").alias("v"), F.count("*").alias("x_n")).join(small(n), "c")
    return g.filter("x_n = x_k").select("c", "i", "j", "v")


def win_part(m: DataFrame, w: int, by: list[str] | None = None) -> DataFrame:
    """Tiles of w x w: (by, wi, wj, i, j, v); ``by`` names the columns of an image's key, which a tile keeps."""
    return m.select(*(by or []), F.floor(F.col("i") / w).cast("int").alias("wi"), F.floor(F.col("j") / w).cast("int").alias("wj"), (F.col("i") % w).alias("i"), (F.col("j") % w).alias("j"), "v")


def win_unpart(m: DataFrame, w: int, by: list[str] | None = None) -> DataFrame:
    """The images of ``win_part``'s tiles: (by, i, j, v)."""
    return m.select(*(by or []), (F.col("wi") * w + F.col("i")).alias("i"), (F.col("wj") * w + F.col("j")).alias("j"), "v")


def sliding_attention(d: DataFrame, window: int | None, s: float) -> DataFrame:
    """(seq, pos, out): softmax(q k s) v over the positions of the sequence up to pos, ``window`` of them at most (all, if None)."""
    return blocks.attend(d, window, s)


def ssm_conv(d: DataFrame, value: str, kernel: list[float]) -> DataFrame:
    """Causal convolution along (seq, pos): the last kernel weight meets the current value; places before the start count 0."""
    w = Window.partitionBy("seq").orderBy("pos")
    k = len(kernel)
    terms = [F.coalesce(F.lag(value, k - 1 - i).over(w), F.lit(0.0)) * c for i, c in enumerate(kernel)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return d.withColumn("out", out)


def ssm_scan(d: DataFrame, a: list[float]) -> DataFrame:
    """Selective scan over (seq, pos, x, dt, b, c): s = s * exp(softplus(dt) a) + b x softplus(dt); out = s c."""
    return scans.scan(d, scans.Selective(a))


def wkv6(d: DataFrame, first: list[float]) -> DataFrame:
    """Recurrent linear attention over (seq, pos, r, k, v, w): the current pair is weighted by ``first``, the state decays by w."""
    return scans.scan(d, scans.Decayed(["r", "k", "v", "w"], np.asarray(first, dtype=np.float64), 1.0))


def wkv7(d: DataFrame) -> DataFrame:
    """Version 7 over (seq, pos, r, w, k, v, a, b): s = s w + v k + (s a) b; out = s r."""
    return scans.scan(d, scans.Rotated())


def gated_linear_attention(d: DataFrame, s: float) -> DataFrame:
    """Over (seq, pos, q, k, v, g): state = state g + k v; out = s * q state."""
    return scans.scan(d, scans.Decayed(["q", "k", "v", "g"], None, s))


def map_custom(f: Callable[..., np.ndarray]):
    """A user function of one to three numpy rows as a vectorised column function."""

    @pandas_udf(ArrayType(DoubleType()))
    def run(*cols: pd.Series) -> pd.Series:  # noqa: ANN002
        return pd.Series([np.asarray(f(*[np.asarray(c, dtype=np.float64) for c in row]), dtype=np.float64).tolist() for row in zip(*cols, strict=True)])

    return run
