"""Binary files as data sources: tensors (``gguf``), quantised log-probabilities (``logprobs``), n-gram caches (``ngram_cache``).

Readers plan byte ranges from a file's header, so one file of any size is read by many tasks, each of which holds a few megabytes; filters on the
columns that a format names prune whole ranges before anything is read. Writers give every task its own part files, each a complete file of its format
of bounded size, and only a commit names them in ``_manifest.json``: readers of a folder follow the manifest, so parts of lost or repeated
tasks are never seen. ``overwrite`` replaces the manifest, then deletes what it named before; ``append`` adds to it.

Paths are those of pyarrow's file systems (``file:``, ``hdfs:``, ``s3:``, ``gs:``), which all executors must reach. A damaged file is an error of the read
that names it, never a shorter result. Register the formats with ``register(spark)``.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .gguf import TENSORS, parse

MANIFEST = "_manifest.json"
RANGE = 8 << 20
PART = 32 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _manifest(f: pafs.FileSystem, base: str) -> list[str] | None:
    at = f"{base}/{MANIFEST}"
    if f.get_file_info(at).type == pafs.FileType.NotFound:
        return None
    with f.open_input_stream(at) as s:
        return json.loads(s.read())["files"]


def files_of(path: str) -> list[str]:
    """The files of a folder (those that its manifest names, if it has one), or the one file."""
    f, base = _open(path)
    if f.get_file_info(base).type == pafs.FileType.File:
        return [base]
    named = _manifest(f, base)
    if named is not None:
        return [f"{base}/{n}" for n in named]
    found = f.get_file_info(pafs.FileSelector(base))
    return sorted(i.path for i in found if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))


@dataclass
class Part(WriterCommitMessage):
    files: list[str]


class PartWriter(DataSourceArrowWriter):
    """Each task's rows as part files: ``encode(batch, state)`` collects, ``finish(state)`` gives the bytes of a complete file."""

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite

    def empty(self) -> list:
        return []

    def add(self, state: list, batch: pa.RecordBatch) -> int:
        """Keeps the batch; returns its size."""
        state.append(batch)
        return batch.nbytes

    def finish(self, state: list) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        f, base = _open(self.path)
        f.create_dir(base, recursive=True)
        state, held, files = self.empty(), 0, []
        task = TaskContext.get()
        no = task.partitionId() if task else 0

        def flush() -> None:
            # In order of name, parts are in order of tasks, and so of rows that were dealt out by range.
            name = f"part-{no:06d}-{len(files):06d}-{uuid.uuid4().hex}.{self.suffix}"
            with f.open_output_stream(f"{base}/{name}") as s:
                s.write(self.finish(state))
            files.append(name)

        for b in iterator:
            for lo in range(0, b.num_rows, 4096):
                held += self.add(state, b.slice(lo, 4096))
                if held >= PART:
                    flush()
                    state, held = self.empty(), 0
        if held:
            flush()
        return Part(files)

    def commit(self, messages: list[Part | None]) -> None:
        f, base = _open(self.path)
        f.create_dir(base, recursive=True)
        before = _manifest(f, base) or []
        fresh = sorted(n for m in messages if m is not None for n in m.files)
        with f.open_output_stream(f"{base}/{MANIFEST}") as s:
            s.write(json.dumps({"files": fresh if self.overwrite else before + fresh}).encode())
        if self.overwrite:
            for n in before:
                f.delete_file(f"{base}/{n}")

    def abort(self, messages: list[Part | None]) -> None:
        f, base = _open(self.path)
        for n in (n for m in messages if m is not None for n in m.files):
            f.delete_file(f"{base}/{n}")


def _bounds(filters: list, column: str) -> tuple[list, set | None, float, float]:
    """What filters on ``column`` leave: (filters that stay), a set of values or None, and an open range."""
    some, low, high = None, float("-inf"), float("inf")
    for x in filters:
        if getattr(x, "attribute", None) != (column,):
            continue
        if isinstance(x, EqualTo):
            some = {x.value} if some is None else some & {x.value}
        elif isinstance(x, In):
            some = set(x.value) if some is None else some & set(x.value)
        elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, x.value)
        elif isinstance(x, (LessThan, LessThanOrEqual)):
            high = min(high, x.value)
    return filters, some, low, high


# Tensors

#: Types that rows are decoded from: numpy type, or a function of the raw bytes of whole blocks.
_PLAIN = {"F32": "<f4", "F16": "<f2", "F64": "<f8", "I8": "i1", "I16": "<i2", "I32": "<i4", "I64": "<i8"}


def _q8(raw: np.ndarray) -> np.ndarray:
    b = raw.reshape(-1, 34)
    return (b[:, :2].copy().view("<f2").astype(np.float64) * b[:, 2:].view("i1")).reshape(-1)


def _bf16(raw: np.ndarray) -> np.ndarray:
    return (raw.view("<u2").astype(np.uint32) << 16).view("<f4").astype(np.float64)


def decode(kind: str, raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.uint8)
    if kind in _PLAIN:
        return x.view(_PLAIN[kind]).astype(np.float64)
    if kind in ("Q8_0", "BF16"):
        return (_q8 if kind == "Q8_0" else _bf16)(x)
    raise ValueError(f"no decoder for tensor type {kind}")


def encode(kind: str, x: np.ndarray) -> bytes:
    if kind == "Q8_0":
        b = x.reshape(-1, 32)
        d = (np.abs(b).max(1) / 127).astype("<f4")
        q = np.rint(np.where(d[:, None] > 0, b / np.where(d > 0, d, 1)[:, None], 0)).astype("i1")
        return np.concatenate([d.astype("<f2").view(np.uint8).reshape(-1, 2), q.view(np.uint8)], axis=1).tobytes()
    return x.astype(_PLAIN[kind]).tobytes()


def read_header(path: str, first: int = 1 << 16) -> tuple[list[tuple], int]:
    """The rows of a file's header and where its data begin, from as little of the file as holds them."""
    f, base = _open(path)
    whole = f.get_file_info(base).size
    with f.open_input_file(base) as s:
        n = first
        while True:
            b = s.read_at(min(n, whole), 0)
            try:
                rows = parse(base, b, whole)
                break
            except (ValueError, struct.error) as e:
                if n >= whole or "truncated" not in str(e) and "size" not in str(e):
                    raise ValueError(f"{base}: {e}") from e
                n *= 4
    tensors = [r for r in rows if r[1] == "tensor"]
    align = next((json.loads(r[4]) for r in rows if r[2] == "general.alignment"), 32)
    end = tensors[-1][6] + -(-tensors[-1][7] // align) * align if tensors else 0
    # Data begin behind the header, aligned; its length is known from the rows' spelling only, so it is found again.
    return rows, _data_start(b, align) if tensors else end


def _data_start(b: bytes, align: int) -> int:
    from .gguf import _Reader

    r = _Reader(b)
    r.at = 8
    n_tensors, n_kv = r.take("Q"), r.take("Q")
    for _ in range(n_kv):
        r.text()
        kind = r.take("I")
        if kind == 9:
            inner, n = r.take("I"), r.take("Q")
            for _ in range(n):
                r.value(inner)
        else:
            r.value(kind)
    for _ in range(n_tensors):
        r.text()
        for _ in range(r.take("I")):
            r.take("Q")
        r.take("I"), r.take("Q")
    return -(-r.at // align) * align


@dataclass
class Rows(InputPartition):
    path: str
    tensor: str
    kind: str
    width: int
    at: int
    first: int
    n: int
    numbers: str  # where the rows' numbers are, if they don't count from 0: "offset:length" in the file

    def __init__(self, path, tensor, kind, width, at, first, n, numbers):  # noqa: D107
        super().__init__(None)
        self.path, self.tensor, self.kind, self.width, self.at, self.first, self.n, self.numbers = path, tensor, kind, width, at, first, n, numbers


ROWS = ".rows"


class TensorReader(DataSourceReader):
    """(tensor, row, values): tensors beside a ``<name>.rows`` tensor of 64-bit numbers take their rows' numbers from it."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.some = path, size, None

    def pushFilters(self, filters: list) -> list:  # noqa: N802
        _, self.some, _, _ = _bounds(filters, "tensor")
        return filters  # rows are filtered again; what is pushed only prunes ranges

    def partitions(self) -> list[Rows]:
        out = []
        for path in files_of(self.path):
            rows, start = read_header(path)
            tensors = {r[2]: r for r in rows if r[1] == "tensor"}
            for name, r in tensors.items():
                if name.endswith(ROWS) or self.some is not None and name not in self.some:
                    continue
                dims = r[5] or [1]
                n = int(np.prod(dims[1:], dtype=np.int64)) if len(dims) > 1 else 1
                _, block, size = next(t for t in TENSORS.values() if t[0] == r[3])
                width, each = dims[0], dims[0] // block * size
                step = max(1, self.size // max(each, 1))
                beside = tensors.get(name + ROWS)
                for lo in range(0, n, step):
                    k = min(step, n - lo)
                    numbers = f"{start + beside[6] + 8 * lo}:{8 * k}" if beside else ""
                    out.append(Rows(path, name, r[3], width, start + r[6] + lo * each, lo, k, numbers))
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        f, base = _open(part.path)
        _, block, size = next(t for t in TENSORS.values() if t[0] == part.kind)
        with f.open_input_file(base) as s:
            raw = s.read_at(part.n * (part.width // block * size), part.at)
            if len(raw) != part.n * (part.width // block * size):
                raise ValueError(f"{base}: truncated data of {part.tensor}")
            no = np.arange(part.first, part.first + part.n, dtype=np.int64)
            if part.numbers:
                at, n = map(int, part.numbers.split(":"))
                no = np.frombuffer(s.read_at(n, at), dtype="<i8")
        ends = pa.array(np.arange(part.n + 1, dtype=np.int32) * part.width)
        values = pa.ListArray.from_arrays(ends, pa.array(decode(part.kind, raw)))
        yield pa.RecordBatch.from_arrays([pa.array([part.tensor] * part.n, pa.string()), pa.array(no), values], ["tensor", "row", "values"])


class TensorWriter(PartWriter):
    """Rows of (tensor, row, values): a part holds its rows of each tensor as one, and their numbers beside it. Values of a tensor have one length."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        super().__init__(path, "gguf", overwrite)
        self.kind = kind

    def finish(self, state: list) -> bytes:
        t = pa.Table.from_batches(state)
        named: dict[str, tuple[list, list]] = {}
        for name, row, values in zip(t.column("tensor").to_pylist(), t.column("row").to_pylist(), t.column("values").to_pylist(), strict=True):
            got = named.setdefault(name, ([], []))
            got[0].append(row)
            got[1].append(values)
        tensors = []
        for name, (numbers, values) in sorted(named.items()):
            x = np.array(values, dtype=np.float64)
            tensors.append((name, self.kind, [x.shape[1], x.shape[0]], encode(self.kind, x)))
            tensors.append((name + ROWS, "I64", [len(numbers)], np.array(numbers, dtype="<i8").tobytes()))
        return gguf_bytes(tensors)


def gguf_bytes(tensors: list[tuple[str, str, list[int], bytes]], align: int = 32) -> bytes:
    """A complete file of tensors (name, type, dims, data)."""
    codes = {v[0]: k for k, v in TENSORS.items()}
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    head, data = [b"GGUF", struct.pack("<IQQ", 3, len(tensors), 0)], []
    at = 0
    for name, kind, dims, raw in tensors:
        head.append(text(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, codes[kind], at))
        data.append(raw + b"\0" * (-len(raw) % align))
        at += len(data[-1])
    top = b"".join(head)
    return top + b"\0" * (-len(top) % align) + b"".join(data)


class GgufSource(DataSource):
    """``gguf``: options path; range_bytes of a reading task; type (F32, F16, F64, Q8_0, I8 to I64) to write."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return "tensor string, row long, values array<double>"

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], self.options.get("type", "F32"), overwrite)


# Log-probabilities

#: Fixed value: the files' magic.
LOGITS = b"_logits_"


@dataclass
class Records(InputPartition):
    path: str
    at: int
    first: int
    n: int
    n_vocab: int
    per_chunk: int

    def __init__(self, path, at, first, n, n_vocab, per_chunk):  # noqa: D107
        super().__init__(None)
        self.path, self.at, self.first, self.n, self.n_vocab, self.per_chunk = path, at, first, n, n_vocab, per_chunk


class LogProbReader(DataSourceReader):
    """(chunk, place, scale, low, q) of files: magic, n_ctx, n_vocab, n_chunk, tokens, then a record of 16-bit numbers for each scored place.

    A record is scale and low as floats, and n_vocab steps, padded to an even number. Of a chunk, the places of its second half but the last are scored.
    """

    def __init__(self, path: str, size: int):
        self.path, self.size, self.low, self.high = path, size, float("-inf"), float("inf")

    def pushFilters(self, filters: list) -> list:  # noqa: N802
        _, some, self.low, self.high = _bounds(filters, "chunk")
        if some:
            self.low, self.high = max(self.low, min(some)), min(self.high, max(some))
        return filters

    def partitions(self) -> list[Records]:
        out, chunks = [], 0
        for path in files_of(self.path):
            f, base = _open(path)
            with f.open_input_file(base) as s:
                head = s.read_at(20, 0)
                if head[:8] != LOGITS or len(head) < 20:
                    raise ValueError(f"{base}: bad magic")
                n_ctx, n_vocab, n_chunk = struct.unpack("<iii", head[8:])
                per = n_ctx - 1 - n_ctx // 2
                each, start = 2 * (4 + n_vocab + n_vocab % 2), 20 + 4 * n_ctx * n_chunk
                if s.size() < start + each * per * n_chunk:
                    raise ValueError(f"{base}: truncated data")
            step = max(1, self.size // each)
            lo = max(0, int(max(self.low - chunks, 0)) * per)
            hi = min(n_chunk * per, int(min(self.high - chunks + 1, n_chunk)) * per)
            out += [Records(path, start + i * each, chunks * per + i, min(step, hi - i), n_vocab, per) for i in range(lo, hi, step)]
            chunks += n_chunk
        return out

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        f, base = _open(part.path)
        wide = 4 + part.n_vocab + part.n_vocab % 2
        with f.open_input_file(base) as s:
            x = np.frombuffer(s.read_at(2 * wide * part.n, part.at), dtype="<u2").reshape(part.n, wide)
        no = np.arange(part.first, part.first + part.n, dtype=np.int64)
        head = x[:, :4].copy().view("<f4").astype(np.float64)
        ends = pa.array(np.arange(part.n + 1, dtype=np.int32) * part.n_vocab)
        q = pa.ListArray.from_arrays(ends, pa.array(x[:, 4 : 4 + part.n_vocab].astype(np.int32).reshape(-1)))
        chunk, place = np.divmod(no, part.per_chunk)
        yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(place.astype(np.int32)), pa.array(head[:, 0]), pa.array(head[:, 1]), q], ["chunk", "place", "scale", "low", "q"])


class LogProbWriter(PartWriter):
    """Rows (chunk, place, scale, low, q), all places of a chunk in one task and in order; chunks are numbered anew by part."""

    def __init__(self, path: str, n_ctx: int, overwrite: bool):
        super().__init__(path, "logits", overwrite)
        self.n_ctx = n_ctx

    def add(self, state: list, batch: pa.RecordBatch) -> int:
        # Parts end with the task: a chunk's records stay together.
        state.append(batch)
        return 1

    def finish(self, state: list) -> bytes:
        t = pa.Table.from_batches(state)
        per = self.n_ctx - 1 - self.n_ctx // 2
        n = len(t)
        if n % per or t.column("place").to_pylist() != list(range(per)) * (n // per):
            raise ValueError("a chunk's places aren't whole and in order")
        q = np.array(t.column("q").to_pylist(), dtype="<u2")
        head = np.stack([t.column("scale").to_numpy(), t.column("low").to_numpy()], axis=1).astype("<f4").view("<u2")
        if q.shape[1] % 2:
            q = np.concatenate([q, np.zeros((n, 1), dtype="<u2")], axis=1)
        n_vocab = len(t.column("q")[0])
        tokens = np.zeros(self.n_ctx * (n // per), dtype="<i4").tobytes()
        return LOGITS + struct.pack("<iii", self.n_ctx, n_vocab, n // per) + tokens + np.concatenate([head, q], axis=1).tobytes()


class LogProbSource(DataSource):
    """``logprobs``: options path; range_bytes; n_ctx to write."""

    @classmethod
    def name(cls) -> str:
        return "logprobs"

    def schema(self) -> str:
        return "chunk long, place int, scale double, low double, q array<int>"

    def reader(self, schema: StructType) -> LogProbReader:
        return LogProbReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> LogProbWriter:
        return LogProbWriter(self.options["path"], int(self.options["n_ctx"]), overwrite)


# N-gram caches


@dataclass
class Stretch(InputPartition):
    path: str
    at: int
    end: int

    def __init__(self, path, at, end):  # noqa: D107
        super().__init__(None)
        self.path, self.at, self.end = path, at, end


INDEX = b"NGIX"
TOKENS = 4


class NgramReader(DataSourceReader):
    """(ngram, next_token, cnt) of files of records: 4 tokens (-1 where shorter), the number of next tokens, and pairs of token and count.

    Files of ``NgramWriter`` end with an index of record starts, by which they are split; others are read by one task, in pieces. Counts below 1 are an error.
    """

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Stretch]:
        out = []
        for path in files_of(self.path):
            f, base = _open(path)
            size = f.get_file_info(base).size
            with f.open_input_file(base) as s:
                tail = s.read_at(min(12, size), max(0, size - 12))
                if len(tail) == 12 and tail[8:] == INDEX:
                    end = struct.unpack("<q", tail[:8])[0]
                    edges = np.frombuffer(s.read_at(size - 12 - end, end), dtype="<i8").tolist()
                else:
                    edges, end = [0], size
            out += [Stretch(path, a, b) for a, b in zip(edges, [*edges[1:], end], strict=True) if b > a]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges at all
            return
        f, base = _open(part.path)
        grams, nexts, counts = [], [], []
        with f.open_input_file(base) as s:
            at, b, i = part.at, b"", 0

            def need(n: int) -> None:
                nonlocal at, b, i
                while len(b) - i < n:
                    more = s.read_at(min(1 << 20, part.end - at), at)
                    if not more:
                        raise ValueError(f"{base}: truncated record")
                    b, i, at = b[i:] + more, 0, at + len(more)

            while i < len(b) or at < part.end:
                need(4 * TOKENS + 4)
                *gram, n = struct.unpack_from(f"<{TOKENS + 1}i", b, i)
                i += 4 * TOKENS + 4
                if n < 1:
                    raise ValueError(f"{base}: a record without tokens")
                need(8 * n)
                pairs = np.frombuffer(b, dtype="<i4", count=2 * n, offset=i)
                i += 8 * n
                if (pairs[1::2] < 1).any():
                    raise ValueError(f"{base}: an n-gram count below 1")
                grams += [[t for t in gram if t != -1]] * n
                nexts += pairs[::2].tolist()
                counts += pairs[1::2].tolist()
                if len(nexts) >= 8192:
                    yield self._batch(grams, nexts, counts)
                    grams, nexts, counts = [], [], []
        if nexts:
            yield self._batch(grams, nexts, counts)

    @staticmethod
    def _batch(grams: list, nexts: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.int32())), pa.array(nexts, pa.int32()), pa.array(counts, pa.int64())], ["ngram", "next_token", "cnt"])


class NgramWriter(PartWriter):
    """Rows (ngram of 1 to 4 tokens, next_token, cnt); rows of an n-gram that come together in a task make one record."""

    def __init__(self, path: str, every: int, overwrite: bool):
        super().__init__(path, "ngrams", overwrite)
        self.every = every

    def finish(self, state: list) -> bytes:
        t = pa.Table.from_batches(state)
        out, edges, size, last, pairs = [], [], 0, None, []

        def record() -> None:
            nonlocal size
            if not pairs:
                return
            if not edges or size - edges[-1] >= self.every:
                edges.append(size)
            out.append(struct.pack(f"<{TOKENS + 1 + 2 * len(pairs)}i", *last, *[-1] * (TOKENS - len(last)), len(pairs), *[x for p in pairs for x in p]))
            size += len(out[-1])

        for gram, token, n in zip(t.column("ngram").to_pylist(), t.column("next_token").to_pylist(), t.column("cnt").to_pylist(), strict=True):
            if not 1 <= len(gram) <= TOKENS or n < 1:
                raise ValueError(f"not a row of an n-gram cache: {gram}, {n}")
            if gram != last:
                record()
                last, pairs = gram, []
            pairs.append((token, n))
        record()
        return b"".join(out) + np.array(edges, dtype="<i8").tobytes() + struct.pack("<q", size) + INDEX


class NgramSource(DataSource):
    """``ngram_cache``: options path; range_bytes between the index's places to write."""

    @classmethod
    def name(cls) -> str:
        return "ngram_cache"

    def schema(self) -> str:
        return "ngram array<int>, next_token int, cnt long"

    def reader(self, schema: StructType) -> NgramReader:
        return NgramReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NgramWriter:
        return NgramWriter(self.options["path"], int(self.options.get("range_bytes", RANGE)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GgufSource, LogProbSource, NgramSource):
        spark.dataSource.register(source)
