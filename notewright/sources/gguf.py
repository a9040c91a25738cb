"""GGUF files as tables: key-value rows and tensor rows, from ``binaryFile`` scans; and a writer for round trips.

A damaged file gives one row with ``error`` in place of its content.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The format's scalar types (code -> struct format), and sizes of tensor types (code -> name, block, bytes).
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
NAMES = {0: "uint8", 1: "int8", 2: "uint16", 3: "int16", 4: "uint32", 5: "int32", 6: "float32", 7: "bool", 8: "string", 9: "array", 10: "uint64", 11: "int64", 12: "float64"}
TENSORS = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 36), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2)}
SCHEMA = "path string, kind string, name string, type string, value string, dims array<long>, offset long, n_bytes long, error string"


class _Reader:
    def __init__(self, b: bytes):
        self.b, self.at = b, 0

    def take(self, fmt: str):
        n = struct.calcsize("<" + fmt)
        if self.at + n > len(self.b):
            raise ValueError("truncated data")
        self.at += n
        return struct.unpack_from("<" + fmt, self.b, self.at - n)[0]

    def text(self) -> str:
        n = self.take("Q")
        if n > len(self.b) - self.at:
            raise ValueError("bad string size")
        self.at += n
        return self.b[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind in SCALARS:
            return self.take(SCALARS[kind])
        raise ValueError(f"bad value type {kind}")


def parse(path: str, b: bytes, whole: int | None = None) -> list[tuple]:
    """Rows of SCHEMA; checks magic, version, duplicate keys and names, alignment, offsets and the data's end.

    ``b`` may be the beginning of a file of ``whole`` bytes, as far as it holds the header.
    """
    r, out, seen, align = _Reader(b), [], set(), 32
    if b[:4] != b"GGUF":
        raise ValueError("bad magic")
    r.at = 4
    if r.take("I") not in (2, 3):
        raise ValueError("bad version")
    n_tensors, n_kv = r.take("Q"), r.take("Q")
    for _ in range(n_kv):
        key, kind = r.text(), None
        if not key or key in seen:
            raise ValueError(f"duplicate or empty key {key!r}")
        seen.add(key)
        kind = r.take("I")
        if kind == 9:
            inner, n = r.take("I"), r.take("Q")
            if inner == 9:
                raise ValueError("array of arrays")
            v, name = [r.value(inner) for _ in range(n)], f"array<{NAMES.get(inner, inner)}>"
        else:
            v, name = r.value(kind), NAMES.get(kind, str(kind))
        if key == "general.alignment":
            align = v
            if not isinstance(v, int) or v <= 0 or v & (v - 1):
                raise ValueError("bad alignment")
        out.append((path, "kv", key, name, json.dumps(v, ensure_ascii=False), None, None, None, None))
    names, want = set(), 0
    tensors = []
    for _ in range(n_tensors):
        name = r.text()
        if name in names:
            raise ValueError(f"duplicate tensor {name!r}")
        names.add(name)
        n_dims = r.take("I")
        if n_dims > 4:
            raise ValueError("bad dims")
        dims = [r.take("Q") for _ in range(n_dims)]
        kind, offset = r.take("I"), r.take("Q")
        if kind not in TENSORS:
            raise ValueError(f"bad tensor type {kind}")
        label, block, size = TENSORS[kind]
        count = 1
        for x in dims:
            count *= x
        if dims and dims[0] % block:
            raise ValueError("bad shape")
        if offset != want:
            raise ValueError(f"bad offset {offset}, not {want}")
        n_bytes = count // block * size
        want += -(-n_bytes // align) * align
        tensors.append((path, "tensor", name, label, None, dims, offset, n_bytes, None))
    start = -(-r.at // align) * align
    if tensors and start + tensors[-1][6] + tensors[-1][7] > (len(b) if whole is None else whole):
        raise ValueError("truncated data")
    return out + tensors


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per key and per tensor of every file under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, b in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += parse(p, bytes(b))
                except (ValueError, struct.error) as e:
                    rows.append((p, "error", None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_headers(spark: SparkSession, pattern: str, first: int = 1 << 20) -> DataFrame:
    """As ``read``, but of files of any size: the driver reads their headers alone, ``first`` bytes and twice as many while they don't suffice."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(p) or []:
        size, n, path = status.getLen(), first, status.getPath().toString()
        while True:
            n = min(n, size)
            stream = fs.open(status.getPath())
            try:
                b = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
            finally:
                stream.close()
            try:
                rows += parse(path, b, size)
            except (ValueError, struct.error) as e:
                if n < size and "truncated" in str(e) or n < size and "bad string size" in str(e):
                    n *= 2
                    continue
                rows.append((path, "error", None, None, None, None, None, None, str(e)))
            break
    return spark.createDataFrame(rows, SCHEMA)


def _encoded(v, kind: int, inner: int | None, order: str) -> bytes:
    text = lambda s: struct.pack(order + "Q", len(s.encode())) + s.encode()
    if kind == 9:
        return struct.pack(order + "IQ", inner, len(v)) + b"".join(_encoded(x, inner, None, order) for x in v)
    return text(v) if kind == 8 else struct.pack(order + SCALARS[kind], v)


#: Bytes that swap together in a tensor's data: plain types whole, blocks in their 16-bit scales at the start.
SWAPS = {0: 4, 1: 2, 25: 2, 26: 4, 27: 8, 28: 8, 30: 2}
SCALED = {2: (18, 1), 3: (20, 2), 6: (22, 1), 7: (24, 2), 8: (34, 1), 9: (36, 2)}


def rewrite(b: bytes, changes: dict[str, tuple[int, object]] | None = None, remove: frozenset[str] = frozenset(), big_endian: bool = False) -> bytes:
    """A file with keys set (type code, value), new ones last, keys removed, or in the other byte order; tensors stay in place.

    Raises ValueError for a damaged file, a change of a key's type, or a data type whose bytes can't be swapped.
    """
    import numpy as np

    codes = {v: k for k, v in NAMES.items()}
    names = {v[0]: k for k, v in TENSORS.items()}
    rows = parse("", b)
    changes, order = dict(changes or {}), ">" if big_endian else "<"
    kv, align, tensors = [], 32, [r for r in rows if r[1] == "tensor"]
    for _, kind, key, label, value, *_ in rows:
        if kind != "kv" or key in remove:
            continue
        inner = codes.get(label[6:-1]) if label.startswith("array<") else None
        code, v = (9 if inner is not None else codes[label]), json.loads(value)
        if key in changes:
            if changes[key][0] != code:
                raise ValueError(f"{key} is {label}")
            v = changes.pop(key)[1]
        kv.append((key, code, inner, v))
        align = v if key == "general.alignment" else align
    kv += [(k, code, None, v) for k, (code, v) in changes.items()]
    text = lambda s: struct.pack(order + "Q", len(s.encode())) + s.encode()
    out = b"GGUF" + struct.pack(order + "IQQ", 3, len(tensors), len(kv))
    out += b"".join(text(k) + struct.pack(order + "I", code) + _encoded(v, code, inner, order) for k, code, inner, v in kv)
    for t in tensors:
        out += text(t[2]) + struct.pack(order + "I", len(t[5])) + b"".join(struct.pack(order + "Q", x) for x in t[5]) + struct.pack(order + "IQ", names[t[3]], t[6])
    old = len(b) - sum(-(-t[7] // align) * align for t in tensors)
    data = bytearray(b[old:])
    for t in tensors if big_endian else []:
        code, part = names[t[3]], slice(t[6], t[6] + t[7])
        x = np.frombuffer(bytes(data[part]), dtype=np.uint8)
        if code in SWAPS:
            x = x.reshape(-1, SWAPS[code])[:, ::-1]
        elif code in SCALED:
            size, halves = SCALED[code]
            x = x.reshape(-1, size).copy()
            for h in range(halves):
                x[:, 2 * h : 2 * h + 2] = x[:, 2 * h : 2 * h + 2][:, ::-1]
        elif code != 24:
            raise ValueError(f"{t[3]} can't be swapped")
        data[part] = x.tobytes()
    return out + b"\0" * (-len(out) % align) + bytes(data)


def content_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sha1, sha256, uuid): hashes of each tensor's bytes and, with a null name, of all of a file's tensors in order."""
    import hashlib
    import uuid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                b = bytes(raw)
                try:
                    tensors = [r for r in parse(p, b) if r[1] == "tensor"]
                except (ValueError, struct.error):
                    continue
                align = next((json.loads(r[4]) for r in parse(p, b) if r[2] == "general.alignment"), 32)
                start = len(b) - sum(-(-t[7] // align) * align for t in tensors)
                whole = [hashlib.sha1(), hashlib.sha256()]
                for t in tensors:
                    data = b[start + t[6] : start + t[6] + t[7]]
                    for h in whole:
                        h.update(data)
                    digest = hashlib.sha1(data)
                    out.append((p, t[2], digest.hexdigest(), hashlib.sha256(data).hexdigest(), str(uuid.UUID(bytes=digest.digest()[:16], version=5))))
                out.append((p, None, whole[0].hexdigest(), whole[1].hexdigest(), str(uuid.UUID(bytes=whole[0].digest()[:16], version=5))))
            yield pd.DataFrame(out, columns=["path", "name", "sha1", "sha256", "uuid"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, sha1 string, sha256 string, uuid string")


def merge_shards(shards: list[bytes]) -> bytes:
    """One file from the shards of a model: the first one's keys without those that count shards, and all tensors in order."""
    kv = [r for r in parse("", shards[0]) if r[1] == "kv" and not r[2].startswith("split.")]
    codes, names = {v: k for k, v in NAMES.items()}, {v[0]: k for k, v in TENSORS.items()}
    keys = []
    for r in kv:
        inner = codes.get(r[3][6:-1]) if r[3].startswith("array<") else None
        keys.append((r[2], 9 if inner is not None else codes[r[3]], inner, json.loads(r[4])))
    align = next((v for k, _, _, v in keys if k == "general.alignment"), 32)
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    infos, data = b"", b""
    n = 0
    for b in shards:
        tensors = [r for r in parse("", b) if r[1] == "tensor"]
        start = len(b) - sum(-(-t[7] // align) * align for t in tensors)
        for t in tensors:
            infos += text(t[2]) + struct.pack("<I", len(t[5])) + b"".join(struct.pack("<Q", x) for x in t[5]) + struct.pack("<IQ", names[t[3]], len(data))
            data += b[start + t[6] : start + t[6] + -(-t[7] // align) * align]
            n += 1
    out = b"GGUF" + struct.pack("<IQQ", 3, n, len(keys)) + b"".join(text(k) + struct.pack("<I", c) + _encoded(v, c, i, "<") for k, c, i, v in keys) + infos
    return out + b"\0" * (-len(out) % align) + data


def write(path: str, kv: list[tuple[str, int, object]], tensors: list[tuple[str, int, list[int], bytes]], align: int = 32) -> None:
    """A small file: kv is (key, type code, value), tensors (name, type code, dims, data)."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(kv))
    for k, kind, v in kv:
        out += text(k) + struct.pack("<I", kind) + (text(v) if kind == 8 else struct.pack("<" + SCALARS[kind], v))
    at, data = 0, b""
    for name, kind, dims, raw in tensors:
        out += text(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", x) for x in dims) + struct.pack("<IQ", kind, at)
        data += raw + b"\0" * (-len(raw) % align)
        at = len(data)
    with open(path, "wb") as f:
        f.write(out + b"\0" * (-len(out) % align) + data)


def dump(d: DataFrame) -> DataFrame:
    """(path, block, elements, percent): a file's tensors by block (the name's second part under blk., else base)."""
    t = d.filter("kind = 'tensor'").withColumn("block", F.when(F.col("name").startswith("blk."), F.split("name", r"\.")[1]).otherwise("base"))
    n = t.groupBy("path", "block").agg(F.sum(F.aggregate("dims", F.lit(1).cast("long"), lambda a, x: a * x)).alias("elements"))
    return n.withColumn("percent", F.round(100 * F.col("elements") / F.sum("elements").over(Window.partitionBy("path")), 2))


def split_plan(d: DataFrame, max_tensors: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Adds shard: by number of tensors, or by the running bytes before each tensor."""
    w = Window.partitionBy("path").orderBy("offset")
    t = d.filter("kind = 'tensor'")
    if max_tensors:
        return t.withColumn("shard", F.floor((F.row_number().over(w) - 1) / max_tensors))
    return t.withColumn("shard", F.floor((F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")) / max_bytes))
