"""Block codecs on array columns: 32 values per block, struct<d, [m], qs>; and their decoders.

Rows whose length isn't a multiple of 32 are an error in the format; here the last block is short.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tensor import let

BLOCK = 32


def blocks(a: Column) -> Column:
    n = F.ceil(F.size(a) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))


def _each(a: Column, f) -> Column:
    return F.transform(blocks(a), f)


def q8_0(a: Column) -> Column:
    """d = max|x| / 127, q = round(x / d)."""
    return _each(a, lambda x: let(F.array_max(F.transform(x, F.abs)) / 127.0, lambda d: F.struct(d.alias("d"), F.transform(x, lambda v: F.when(d > 0, F.floor(v / d + 0.5)).otherwise(0).cast("int")).alias("qs"))))


def q8_1(a: Column) -> Column:
    """As q8_0, with s = d times the sum of q, which spares products with an affine block that sum."""
    total = lambda qs: F.aggregate(qs, F.lit(0), lambda t, q: t + q)
    return F.transform(q8_0(a), lambda b: F.struct(b["d"].alias("d"), (b["d"] * total(b["qs"])).alias("s"), b["qs"].alias("qs")))


def _signed_max(x: Column) -> Column:
    """The value with the largest magnitude, the first on ties."""
    return F.element_at(F.array_sort(F.transform(x, lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("i"), v.alias("v")))), 1)["v"]


def q4_0(a: Column) -> Column:
    """d = extreme / -8, q = min(15, x / d + 8.5)."""
    return _each(a, lambda x: let(_signed_max(x) / -8.0, lambda d: F.struct(d.alias("d"), F.transform(x, lambda v: F.when(d != 0, F.least(F.lit(15), F.floor(v / d + 8.5).cast("int"))).otherwise(8)).alias("qs"))))


def q5_0(a: Column) -> Column:
    """d = extreme / -16, q = min(31, x / d + 16.5)."""
    return _each(a, lambda x: let(_signed_max(x) / -16.0, lambda d: F.struct(d.alias("d"), F.transform(x, lambda v: F.when(d != 0, F.least(F.lit(31), F.floor(v / d + 16.5).cast("int"))).otherwise(16)).alias("qs"))))


def _affine(a: Column, top: int) -> Column:
    def one(x):
        ends = F.struct(F.array_min(x).alias("m"), ((F.array_max(x) - F.array_min(x)) / top).alias("d"))
        return let(ends, lambda e: F.struct(e["d"].alias("d"), e["m"].alias("m"), F.transform(x, lambda v: F.when(e["d"] > 0, F.least(F.lit(top), F.floor((v - e["m"]) / e["d"] + 0.5).cast("int"))).otherwise(0)).alias("qs")))

    return _each(a, one)


def q4_1(a: Column) -> Column:
    """d = (max - min) / 15, q = (x - min) / d."""
    return _affine(a, 15)


def q5_1(a: Column) -> Column:
    """d = (max - min) / 31, q = (x - min) / d."""
    return _affine(a, 31)


def decode(b: Column, kind: str) -> Column:
    zero = {"q8_0": 0, "q8_1": 0, "q4_0": 8, "q5_0": 16}
    if kind in zero:
        return F.flatten(F.transform(b, lambda x: F.transform(x["qs"], lambda q: (q - zero[kind]) * x["d"])))
    return F.flatten(F.transform(b, lambda x: F.transform(x["qs"], lambda q: q * x["d"] + x["m"])))
