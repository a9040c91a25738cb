"""Layout and 2-D tensor operators on index rows: every element is a row of its index columns and ``v``.

``by`` names further index columns (channel, image, head) that an operator leaves alone. Elements that are absent count as 0,
so zero padding needs no rows. Sums are partial before they are shuffled; kernels are broadcast up to ``SMALL`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from . import tensor as T

SMALL, small = T.SMALL, T.small


def grid(d: DataFrame, array: str, width: int, by: list[str]) -> DataFrame:
    """(by, i, j, v) of an array column read as rows of ``width`` values."""
    x = d.select(*by, F.posexplode(array).alias("x_n", "v"))
    return x.select(*by, F.floor(F.col("x_n") / width).cast("int").alias("i"), (F.col("x_n") % width).alias("j"), "v")


def concat_dim(a: DataFrame, b: DataFrame, dim: str, size: int) -> DataFrame:
    """``b`` behind ``a`` along the index ``dim``, of which ``a`` has ``size`` places."""
    return a.unionByName(b.withColumn(dim, (F.col(dim) + size).cast(dict(a.dtypes)[dim])))


def reshape(m: DataFrame, old_width: int, new_width: int) -> DataFrame:
    """(i, j, v) with rows of another width; the elements keep their linear order."""
    n = F.col("i").cast("long") * old_width + F.col("j")
    return m.withColumn("x_n", n).withColumn("i", F.floor(F.col("x_n") / new_width)).withColumn("j", F.col("x_n") % new_width).drop("x_n")


def permute(m: DataFrame, axes: dict[str, str]) -> DataFrame:
    """Renames index columns among themselves: ``axes`` maps an old index to its new name."""
    return m.select(*[F.col(c).alias(axes.get(c, c)) for c in m.columns])


def diag(a: Column) -> Column:
    """Square matrix (array of rows) with ``a`` on its diagonal."""
    return F.transform(a, lambda x, i: F.transform(a, lambda y, j: F.when(i == j, x).otherwise(0.0)))


def out_prod(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, k, v): sum over the shared row r of a(r, i) b(r, k), by tiles; inputs (by, r, i, v) and (by, r, k, v)."""
    return blocks.product(a, b, "r", "i", "k", by)


def im2col_2d(m: DataFrame, kh: int, kw: int, stride: int, pad: int, dilation: int, h: int, w: int, by: list[str]) -> DataFrame:
    """(by, oi, oj, ki, kj, v): the non-zero elements of every patch of an h x w image."""
    rows = (h + 2 * pad - dilation * (kh - 1) - 1) // stride
    cols = (w + 2 * pad - dilation * (kw - 1) - 1) // stride
    x = m.withColumn("ki", F.explode(F.sequence(F.lit(0), F.lit(kh - 1)))).withColumn("kj", F.explode(F.sequence(F.lit(0), F.lit(kw - 1))))
    x = x.withColumn("x_i", F.col("i") + pad - F.col("ki") * dilation).withColumn("x_j", F.col("j") + pad - F.col("kj") * dilation)
    fits = (F.col("x_i") >= 0) & (F.col("x_j") >= 0) & (F.col("x_i") % stride == 0) & (F.col("x_j") % stride == 0)
    oi, oj = F.floor(F.col("x_i") / stride).cast("int"), F.floor(F.col("x_j") / stride).cast("int")
    x = x.filter(fits).select(*by, oi.alias("oi"), oj.alias("oj"), "ki", "kj", "v")
    return x.filter((F.col("oi") <= rows) & (F.col("oj") <= cols))


def im2col_2d_back(p: DataFrame, stride: int, pad: int, dilation: int, by: list[str]) -> DataFrame:
    """(by, i, j, v): patches added back into the image."""
    i = (F.col("oi") * stride + F.col("ki") * dilation - pad).alias("i")
    j = (F.col("oj") * stride + F.col("kj") * dilation - pad).alias("j")
    return p.select(*by, i, j, "v").groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def conv_2d(m: DataFrame, kernel: DataFrame, kh: int, kw: int, stride: int, pad: int, dilation: int, h: int, w: int, by: list[str]) -> DataFrame:
    """(by, oi, oj, v) with kernel (ki, kj, w): patches times the kernel, summed per place."""
    p = im2col_2d(m, kh, kw, stride, pad, dilation, h, w, by).join(small(kernel), ["ki", "kj"])
    return p.groupBy(*by, "oi", "oj").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def conv_transpose_2d(m: DataFrame, kernel: DataFrame, stride: int, by: list[str]) -> DataFrame:
    """(by, i, j, v): every element spreads the kernel (ki, kj, w) from its place times ``stride``."""
    x = m.crossJoin(F.broadcast(kernel)) if kernel.limit(SMALL + 1).count() <= SMALL else m.withColumn("x_k", F.lit(1)).join(kernel.withColumn("x_k", F.lit(1)), "x_k")
    i, j = (F.col("i") * stride + F.col("ki")).alias("i"), (F.col("j") * stride + F.col("kj")).alias("j")
    return x.select(*by, i, j, (F.col("v") * F.col("w")).alias("v")).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def _covering(m: DataFrame, k: int, stride: int) -> DataFrame:
    """Adds oi, oj: the k x k windows that cover the element."""
    first = lambda c: F.greatest(F.ceil((F.col(c) - k + 1) / stride).cast("int"), F.lit(0))
    last = lambda c: F.floor(F.col(c) / stride).cast("int")
    return m.withColumn("oi", F.explode(F.sequence(first("i"), last("i")))).withColumn("oj", F.explode(F.sequence(first("j"), last("j"))))


def pool_2d_back(m: DataFrame, grad: DataFrame, k: int, stride: int, by: list[str], kind: str = "avg") -> DataFrame:
    """(by, i, j, v): the gradient (by, oi, oj, g) of k x k windows led back to the elements that made their output.

    An average spreads its gradient evenly; a maximum gives it to its first largest element.
    """
    key = [*by, "oi", "oj"]
    x = _covering(m, k, stride).join(grad, key)
    if kind == "avg":
        return x.groupBy(*by, "i", "j").agg((F.sum("g") / (k * k)).alias("v"))
    top = x.groupBy(*key).agg(F.max(F.struct("v", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))).alias("t"), F.first("g").alias("g"))
    won = top.select(*by, (-F.col("t.ni")).alias("i"), (-F.col("t.nj")).alias("j"), "g")
    return won.groupBy(*by, "i", "j").agg(F.sum("g").alias("v"))


def get_rel_pos(table: DataFrame, q: int, k: int) -> DataFrame:
    """(qi, ki, c, v): row k - ki - 1 + qi of the table (row, c, v) for every query and key place."""
    x = table.withColumn("qi", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).withColumn("ki", F.col("qi") + (k - 1) - F.col("row"))
    return x.filter((F.col("ki") >= 0) & (F.col("ki") < k)).select("qi", "ki", "c", "v")


def add_rel_pos(scores: DataFrame, rel_h: DataFrame, rel_w: DataFrame) -> DataFrame:
    """Scores (q, kh, kw, v) plus rel_h (q, kh, v) and rel_w (q, kw, v)."""
    x = scores.join(rel_h.withColumnRenamed("v", "x_h"), ["q", "kh"]).join(rel_w.withColumnRenamed("v", "x_w"), ["q", "kw"])
    return x.select("q", "kh", "kw", (F.col("v") + F.col("x_h") + F.col("x_w")).alias("v"))


def attention(d: DataFrame, window: int | None, scale: float, softcap: float = 0.0, slope: float = 1.0, mask: str | None = None) -> DataFrame:
    """(seq, pos, out): attention over the last ``window`` positions (all, if None) of (seq, pos, q, k, v), with soft cap and a mask per key.

    ``mask`` is a column of the key's row, added with ``slope``; a null mask takes the key out.
    """
    d = d if mask is None else d.withColumn("x_mask", F.col(mask) * slope)
    return blocks.attend(d, window, scale, softcap, None if mask is None else "x_mask")


def yarn_range(n_dims: int, base: float, n_ctx: int, fast: float, slow: float) -> tuple[float, float]:
    """First and last pair over which positions pass from extrapolated to interpolated."""
    at = lambda turns: n_dims * math.log(n_ctx / (turns * 2 * math.pi)) / (2 * math.log(base))
    return max(0.0, math.floor(at(fast))), min(n_dims - 1.0, math.ceil(at(slow)))


def rope_yarn(
    a: Column, pos: Column, n_dims: int, base: float = 10_000.0, freq_scale: float = 1.0, ext: float = 1.0, attn: float = 1.0, n_ctx: int = 4096, fast: float = 32.0, slow: float = 1.0
) -> Column:
    """Rotary positions of neighbouring pairs, stretched to longer contexts: high frequencies as they are, low ones scaled."""
    low, high = yarn_range(n_dims, base, n_ctx, fast, slow)
    size = attn * (1 + 0.1 * math.log(1 / freq_scale)) if ext else attn

    def one(i: Column) -> Column:
        pair = F.floor(i / 2).cast("int")
        free = pos * F.pow(F.lit(base), -2.0 * pair / n_dims)
        ramp = ext * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (pair - low) / max(0.001, high - low))))
        angle = free * freq_scale * (1 - ramp) + free * ramp
        x0, x1 = F.get(a, pair * 2), F.get(a, pair * 2 + 1)
        turned = F.when(i % 2 == 0, x0 * F.cos(angle) - x1 * F.sin(angle)).otherwise(x0 * F.sin(angle) + x1 * F.cos(angle))
        return F.when(i < n_dims, turned * size).otherwise(F.get(a, i))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)


def rope_sections(a: Column, positions: Column, n_dims: int, sections: list[int], base: float = 10_000.0) -> Column:
    """Rotary positions of halves, in which each section of pairs turns by a position of its own (time, height, width)."""
    half, whole = n_dims // 2, sum(sections)
    ends = [sum(sections[: k + 1]) for k in range(len(sections))]

    def one(i: Column) -> Column:
        pair = i % half
        at = F.lit(len(sections) - 1)
        for k in reversed(range(len(ends))):
            at = F.when(pair % whole < ends[k], F.lit(k)).otherwise(at)
        angle = F.get(positions, at) * F.pow(F.lit(base), -2.0 * pair / n_dims)
        x0, x1 = F.get(a, pair), F.get(a, pair + half)
        turned = F.when(i < half, x0 * F.cos(angle) - x1 * F.sin(angle)).otherwise(x0 * F.sin(angle) + x1 * F.cos(angle))
        return F.when(i < n_dims, turned).otherwise(F.get(a, i))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)


def dup(a: Column, kind: str) -> Column:
    """Copy with another element type (dup, cpy, cont): ``array<kind>``."""
    return a.cast(f"array<{kind}>")


def cross_entropy_grad(a: Column, target: Column, n_rows: Column) -> Column:
    """Gradient of the mean cross-entropy by the logits: (softmax(a) - target) / n_rows."""
    return T.cross_entropy_back(a, target, F.lit(1.0), n_rows)
