"""Packed block codecs on binary columns: bfloat16, ternary blocks, and decoders of the 256-value super-blocks.

A row is a run of blocks as bytes; whole Arrow batches are decoded at once with NumPy. Decoders give float32 values as doubles. Bytes behind the
last whole block are an error of the format and make the row null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPER = 256
#: Rows whose values are held at once.
SLICE = 256


def _half(b: np.ndarray) -> np.ndarray:
    """float16 fields of two bytes, as a column."""
    return np.ascontiguousarray(b).view(np.float16).astype(np.float32)


def bf16_encode(x: np.ndarray) -> np.ndarray:
    """The upper halves of float32 values, rounded to even; a NaN keeps its sign and becomes quiet."""
    n = x.astype(np.float32).view(np.uint32)
    nan = (n & 0x7FFFFFFF) > 0x7F800000
    rounded = (n + (0x7FFF + ((n >> 16) & 1))) >> 16
    return np.where(nan, (n >> 16) | 64, rounded).astype(np.uint16)


def bf16_decode(q: np.ndarray) -> np.ndarray:
    return (q.astype(np.uint32) << 16).view(np.float32)


def _six_bits(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight scales and eight minima of 6 bits from 12 bytes."""
    a, b, c = s[:, :4], s[:, 4:8], s[:, 8:]
    scale = np.concatenate([a & 63, (c & 15) | (a >> 6 << 4)], axis=1)
    least = np.concatenate([b & 63, (c >> 4) | (b >> 6 << 4)], axis=1)
    return scale.astype(np.float32), least.astype(np.float32)


def _planes(q: np.ndarray, run: int, bits: int) -> np.ndarray:
    """Fields of ``bits`` bits: of every ``run`` bytes first all lowest fields, then the next."""
    q = q.reshape(len(q), -1, 1, run)
    shift = np.arange(0, 8, bits, dtype=np.uint8).reshape(1, 1, -1, 1)
    return ((q >> shift) & (2**bits - 1)).reshape(len(q), -1)


def q2_k(b: np.ndarray) -> np.ndarray:
    scales, d, least = b[:, :16], _half(b[:, 80:82]), _half(b[:, 82:84])
    q = _planes(b[:, 16:80], 32, 2).reshape(len(b), 16, 16).astype(np.float32)
    return (d * (scales & 15)).reshape(-1, 16, 1) * q - (least * (scales >> 4)).reshape(-1, 16, 1)


def q3_k(b: np.ndarray) -> np.ndarray:
    mask, s, d = b[:, :32], b[:, 96:108], _half(b[:, 108:110])
    low = np.concatenate([s[:, :8] & 15, s[:, :8] >> 4], axis=1)
    high = ((s[:, None, 8:12] >> np.arange(0, 8, 2, dtype=np.uint8).reshape(1, 4, 1)) & 3).reshape(len(b), 16)
    scale = (low | high << 4).astype(np.float32) - 32
    q = _planes(b[:, 32:96], 32, 2).astype(np.float32)
    top = ((mask[:, None, :] >> np.arange(8, dtype=np.uint8).reshape(1, 8, 1)) & 1).reshape(len(b), SUPER)
    return (d * scale).reshape(-1, 16, 1) * (q - np.where(top, 0, 4)).reshape(-1, 16, 16)


def q4_k(b: np.ndarray) -> np.ndarray:
    scale, least = _six_bits(b[:, 4:16])
    q = _planes(b[:, 16:144], 32, 4).reshape(len(b), 8, 32).astype(np.float32)
    return (_half(b[:, :2]) * scale)[:, :, None] * q - (_half(b[:, 2:4]) * least)[:, :, None]


def q5_k(b: np.ndarray) -> np.ndarray:
    scale, least = _six_bits(b[:, 4:16])
    low = _planes(b[:, 48:176], 32, 4).reshape(len(b), 8, 32)
    top = (b[:, None, 16:48] >> np.arange(8, dtype=np.uint8).reshape(1, 8, 1)) & 1
    q = (low | top << 4).astype(np.float32)
    return (_half(b[:, :2]) * scale)[:, :, None] * q - (_half(b[:, 2:4]) * least)[:, :, None]


def q6_k(b: np.ndarray) -> np.ndarray:
    low = _planes(b[:, :128], 64, 4).reshape(len(b), 2, 4, 32)
    high = _planes(b[:, 128:192], 32, 2).reshape(len(b), 2, 4, 32)
    scale = b[:, 192:208].view(np.int8).astype(np.float32)
    q = (low | high << 4).reshape(len(b), 16, 16).astype(np.float32) - 32
    return (_half(b[:, 208:210]) * scale)[:, :, None] * q


def tq2_0(b: np.ndarray) -> np.ndarray:
    return _half(b[:, 64:66]) * (_planes(b[:, :64], 32, 2).astype(np.float32) - 1)


def _trits(b: np.ndarray, run: int, count: int) -> np.ndarray:
    """``count`` base-3 digits of every byte, highest first; of every ``run`` bytes first all first digits."""
    b = b.reshape(len(b), -1, 1, run)
    power = (3 ** np.arange(count)).astype(np.uint8).reshape(1, 1, -1, 1)
    return ((b * power).astype(np.uint16) * 3 >> 8).reshape(len(b), -1)


def tq1_0(b: np.ndarray) -> np.ndarray:
    q = np.concatenate([_trits(b[:, :32], 32, 5), _trits(b[:, 32:48], 16, 5), _trits(b[:, 48:52], 4, 4)], axis=1)
    return _half(b[:, 52:54]) * (q.astype(np.float32) - 1)


def tq2_0_encode(x: np.ndarray) -> np.ndarray:
    """(blocks, 66) bytes of (blocks, 256) values: signs of what rounds to the largest magnitude."""
    d = np.abs(x).max(1, keepdims=True).astype(np.float32)
    q = np.clip(np.rint(np.divide(x, d, out=np.zeros_like(x, dtype=np.float32), where=d > 0)), -1, 1).astype(np.int8) + 1
    q = q.reshape(len(x), 2, 4, 32).astype(np.uint8) << np.arange(0, 8, 2, dtype=np.uint8).reshape(1, 1, 4, 1)
    return np.concatenate([np.bitwise_or.reduce(q, axis=2).reshape(len(x), 64), d.astype(np.float16).view(np.uint8).reshape(len(x), 2)], axis=1)


def tq1_0_encode(x: np.ndarray) -> np.ndarray:
    """(blocks, 54) bytes of (blocks, 256) values: five ternary digits a byte."""
    d = np.abs(x).max(1, keepdims=True).astype(np.float32)
    q = np.clip(np.rint(np.divide(x, d, out=np.zeros_like(x, dtype=np.float32), where=d > 0)), -1, 1).astype(np.int32) + 1

    def pack(part: np.ndarray, count: int) -> np.ndarray:
        total = sum(part[:, k] * 3 ** (4 - k) for k in range(count))
        return ((total * 256 + 242) // 243).astype(np.uint8)

    parts = [pack(q[:, :160].reshape(-1, 5, 32), 5), pack(q[:, 160:240].reshape(-1, 5, 16), 5), pack(q[:, 240:].reshape(-1, 4, 4), 4)]
    return np.concatenate([*parts, d.astype(np.float16).view(np.uint8).reshape(len(x), 2)], axis=1)


#: Bytes of a block and its decoder. The sizes of the format.
CODECS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "q2_k": (84, q2_k), "q3_k": (110, q3_k), "q4_k": (144, q4_k), "q5_k": (176, q5_k), "q6_k": (210, q6_k), "tq1_0": (54, tq1_0), "tq2_0": (66, tq2_0),
    "bf16": (2, lambda b: bf16_decode(np.ascontiguousarray(b).view(np.uint16))),
}
ENCODERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "tq1_0": tq1_0_encode, "tq2_0": tq2_0_encode, "bf16": lambda x: bf16_encode(x.reshape(-1)).view(np.uint8).reshape(len(x), -1),
}


def decode_bytes(raw: bytes, kind: str) -> np.ndarray | None:
    size, f = CODECS[kind]
    if len(raw) % size:
        return None
    return f(np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)).reshape(-1) if raw else np.zeros(0, dtype=np.float32)


def _mapped(d: DataFrame, column: str, keep: list[str], out: str, kind: pa.DataType, f: Callable) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in d.select(*keep).dtypes) + f", {out}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, lo in ((b, lo) for b in batches for lo in range(0, b.num_rows, SLICE)):
            b = whole.slice(lo, SLICE)
            values = [None if x is None else f(x) for x in b.column("x_in").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(values, kind)], [*keep, out.split(" ")[0]])

    return d.select(*keep, F.col(column).alias("x_in")).mapInArrow(run, schema)


def decode(d: DataFrame, column: str, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` and v (array<double>) of a binary column of blocks."""

    def f(raw: bytes) -> list[float] | None:
        got = decode_bytes(raw, kind)
        return None if got is None else got.astype(np.float64).tolist()

    return _mapped(d, column, keep, "v array<double>", pa.list_(pa.float64()), f)


def encode(d: DataFrame, column: str, kind: str, keep: list[str]) -> DataFrame:
    """``keep`` and blocks (binary) of an array column, the last block filled up with zeros."""

    def f(values: list[float]) -> bytes:
        x = np.asarray(values, dtype=np.float32)
        width = 1 if kind == "bf16" else SUPER
        return ENCODERS[kind](np.pad(x, (0, -len(x) % width)).reshape(-1, width)).tobytes() if len(x) else b""

    return _mapped(d, column, keep, "blocks binary", pa.binary(), f)


#: Rules up to which they become one expression.
FEW_RULES = 1_000


def choose_types(tensors: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Adds type to (name, ...): that of the first rule (priority, pattern, type) whose pattern is found in the name.

    A few rules are one expression. More are joined to the different names, so repeated rows stay as they are.
    """
    few = rules.select("priority", "pattern", "type").orderBy("priority").limit(FEW_RULES + 1).collect()
    if len(few) <= FEW_RULES:
        kind = F.lit(default)
        for r in reversed(few):
            kind = F.when(F.col("name").rlike(r["pattern"]), F.lit(r["type"])).otherwise(kind)
        return tensors.withColumn("type", kind)
    hit = tensors.select(F.col("name").alias("x_name")).distinct().join(rules, F.expr("regexp(x_name, pattern)"))
    first = hit.groupBy("x_name").agg(F.min_by("type", "priority").alias("x_t"))
    return tensors.join(first, F.col("name") == F.col("x_name"), "left").select(*tensors.columns, F.coalesce("x_t", F.lit(default)).alias("type"))


def merge_low_rank(base: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """(name, i, j, v): base plus scale times B A of each tensor; a (name, r, j, v), b (name, i, r, v). Tensors without an adapter stay."""
    x = b.withColumnRenamed("v", "x_b").join(a.withColumnRenamed("v", "x_a"), ["name", "r"])
    delta = x.groupBy("name", "i", "j").agg((scale * F.sum(F.col("x_a") * F.col("x_b"))).alias("x_d"))
    m = base.join(delta, ["name", "i", "j"], "left")
    return m.select("name", "i", "j", (F.col("v") + F.coalesce("x_d", F.lit(0.0))).alias("v"))
