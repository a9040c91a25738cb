"""Tokenisers: rank-merge BPE on bytes, score-merge pieces, word pieces, unigram and greedy byte tries; special tokens; detokenising.

A tokeniser is a plain Python object that is sent to the workers once, with its vocabulary (bounded by the vocabulary file, some 10^5
entries). ``encode`` runs it over a text column in slices of Arrow batches. A text is cut into units that no token crosses; equal units are
encoded once per worker, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-split patterns of two families.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LLAMA3 = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: The same first pattern for Java, which has \p{L} and look-ahead too; white space is Unicode's.
GPT2_JAVA = r"(?U)('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"

#: A word with the marks before it, or marks at the end.
MARKED = regex.compile("▁*[^▁]+|▁+")
BLANKED = regex.compile(b" *[^ ]+| +")


def presplit(text: F.Column) -> F.Column:
    """Unicode-class pre-tokens of a text column, in the JVM."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GPT2_JAVA), F.lit(1))


def _merge(symbols: list, value: Callable) -> list:
    """Joins neighbours by the least ``value(left, right)`` (None: never), the leftmost of equal ones first.

    A heap over a linked list: n log n for a word of n symbols.
    """
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple] = []

    def push(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (v := value(symbols[i], symbols[j])) is not None:
            heapq.heappush(heap, (v, i, j, symbols[i], symbols[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if symbols[i] != a or after[i] != j or symbols[j] != b or symbols[j] is None:
            continue
        symbols[i], symbols[j] = a + b, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(before[i])
        push(i)
    return [s for s in symbols if s is not None]


#: Units that a worker remembers, and their longest.
MOST_UNITS, LONGEST_UNIT = 100_000, 64


class Tokenizer:
    """Common part: special tokens are cut out of the text first, longest first; units are cached."""

    kind = "none"

    def __init__(self, special: dict[str, int] | None = None):
        self.special, self.seen = special or {}, {}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts give none."""
        if not text:
            return []
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        seen = self.seen
        for u in self.units(text):
            ids = seen.get(u)
            if ids is None:
                ids = self.unit(u)
                if len(seen) < MOST_UNITS and len(u) <= LONGEST_UNIT:
                    seen[u] = ids
            out += ids
        return out

    def units(self, text: str) -> Iterable:
        """Parts of the text that are encoded by themselves."""
        raise NotImplementedError

    def unit(self, unit) -> list[int]:
        raise NotImplementedError


def starts_only(pieces: Iterable, mark) -> bool:
    """Whether ``mark`` stands in pieces only as a run at their start, so that none reaches into the next marked word."""
    return not any(mark in p.lstrip(mark) for p in pieces)


class ByteBpe(Tokenizer):
    """Byte-level BPE by ranks: words of a pre-split pattern, their bytes merged in rank order."""

    kind = "bpe"

    def __init__(self, ranks: dict[bytes, int], pattern: str = GPT2, special: dict[str, int] | None = None):
        super().__init__(special)
        self.ranks, self.pattern = ranks, pattern
        self.words = None

    def __getstate__(self) -> dict:
        return {**super().__getstate__(), "words": None}

    def word(self, raw: bytes) -> list[int]:
        if raw in self.ranks:
            return [self.ranks[raw]]
        pieces = _merge([raw[i : i + 1] for i in range(len(raw))], lambda a, b: self.ranks.get(a + b))
        return [self.ranks[p] for p in pieces]

    def units(self, text: str) -> Iterable[str]:
        if self.words is None:
            self.words = regex.compile(self.pattern)
        return (m[0] for m in self.words.finditer(text))

    def unit(self, unit: str) -> list[int]:
        return self.word(unit.encode("utf-8", "replace"))

    def decode(self, ids: Iterable[int]) -> str:
        back = {v: k for k, v in self.ranks.items()} | {v: k.encode() for k, v in self.special.items()}
        return b"".join(back[i] for i in ids).decode("utf-8", "replace")


class ScorePieces(Tokenizer):
    """Score-merge pieces: characters joined by the best score, what is no piece falls back to bytes."""

    kind = "spm"
    SPACE = "▁"

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: dict[int, int], unknown: int = 0, dummy: bool = True, special: dict[str, int] | None = None):
        super().__init__(special)
        self.scores, self.ids, self.byte_ids, self.unknown, self.dummy = scores, ids, byte_ids, unknown, dummy
        self.apart = starts_only(scores, self.SPACE)

    def units(self, text: str) -> Iterable[str]:
        """Marked words, if no piece reaches from one into the next: then no merge does."""
        text = (self.SPACE if self.dummy else "") + text.replace(" ", self.SPACE)
        return (m[0] for m in MARKED.finditer(text)) if self.apart else [text]

    def unit(self, unit: str) -> list[int]:
        worth = lambda a, b: -self.scores[a + b] if a + b in self.scores else None
        out: list[int] = []
        for p in _merge(list(unit), worth):
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        back, raw = {v: k for k, v in self.ids.items()}, {v: k for k, v in self.byte_ids.items()}
        data = b"".join(bytes([raw[i]]) if i in raw else back[i].replace(self.SPACE, " ").encode() for i in ids)
        text = data.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


class WordPieces(Tokenizer):
    """Word pieces: decomposed, lower case, accents off, punctuation and ideographs alone; greedy longest match in each word."""

    kind = "wpm"

    def __init__(self, ids: dict[str, int], unknown: int, first: str = "", inner: str = "##", special: dict[str, int] | None = None):
        super().__init__(special)
        self.ids, self.unknown, self.first, self.inner = ids, unknown, first, inner
        self.longest = max(map(len, ids), default=0)

    @staticmethod
    def split(text: str) -> list[str]:
        out: list[str] = []
        word = ""
        for c in unicodedata.normalize("NFD", text):
            kind = unicodedata.category(c)
            alone = kind[0] == "P" or (kind[0] == "S" and ord(c) < 128) or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF
            if c.isspace() or kind in ("Cc", "Cf") or alone:
                out += [word] * bool(word) + [c] * alone
                word = ""
            elif kind != "Mn" and c != "�":
                word += c.lower()
        return out + [word] * bool(word)

    def units(self, text: str) -> Iterable[str]:
        """White space parts words, and decomposing reorders no accents across it."""
        return text.split()

    def unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for w in self.split(unit):
            at, got = 0, []
            while at < len(w):
                lead = self.inner if at else self.first
                n = next((n for n in range(min(len(w) - at, self.longest), 0, -1) if lead + w[at : at + n] in self.ids), 0)
                if not n:
                    got = [self.unknown]
                    break
                got.append(self.ids[lead + w[at : at + n]])
                at += n
            out += got
        return out


class Unigram(Tokenizer):
    """Unigram pieces: the segmentation with the best sum of scores; a character that no piece covers is unknown, at a penalty."""

    kind = "ugm"

    def __init__(self, scores: dict[str, float], ids: dict[str, int], unknown: int = 0, penalty: float = 10.0, special: dict[str, int] | None = None):
        super().__init__(special)
        self.scores, self.ids, self.unknown = scores, ids, unknown
        self.low = min(scores.values(), default=0.0) - penalty
        self.longest = max(map(len, scores), default=1)
        self.apart = starts_only(scores, "▁")

    def plain(self, text: str) -> list[int]:
        """Neighbouring unknown characters are one token, across units too."""
        ids, unknown = super().plain(text), self.unknown
        return [k for k, before in zip(ids, [None, *ids]) if k != unknown or before != unknown]

    def units(self, text: str) -> Iterable[str]:
        """Marked words, if no piece reaches from one into the next: then their best sums add up to the text's."""
        text = "▁" + text.replace(" ", "▁")
        return (m[0] for m in MARKED.finditer(text)) if self.apart else [text]

    def unit(self, unit: str) -> list[int]:
        text = unit
        best, back = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        for i in range(len(text)):
            for n in range(1, min(self.longest, len(text) - i) + 1):
                s = self.scores.get(text[i : i + n], self.low if n == 1 else None)
                if s is not None and best[i] + s > best[i + n]:
                    best[i + n], back[i + n] = best[i] + s, i
        out, at = [], len(text)
        while at:
            out.append(self.ids.get(text[back[at] : at], self.unknown))
            at = back[at]
        return out[::-1]


class GreedyBytes(Tokenizer):
    """Longest match over bytes from left to right."""

    kind = "rwkv"

    def __init__(self, ids: dict[bytes, int], unknown: int = 0, special: dict[str, int] | None = None):
        super().__init__(special)
        self.ids, self.unknown = ids, unknown
        self.apart, self.begun = starts_only(ids, b" "), None

    def __getstate__(self) -> dict:
        return {**super().__getstate__(), "begun": None}

    def units(self, text: str) -> Iterable[bytes]:
        """Words with the blanks before them, if no token reaches from one into the next: then a match never crosses their border."""
        raw = text.encode("utf-8", "replace")
        return (m[0] for m in BLANKED.finditer(raw)) if self.apart else [raw]

    def unit(self, unit: bytes) -> list[int]:
        if self.begun is None:  # what a token begins with: a match is followed only as far as one may still come
            self.begun = {t[:n] for t in self.ids for n in range(1, len(t))}
        out, at = [], 0
        while at < len(unit):
            end, n, found = len(unit), 1, None
            while at + n <= end:
                part = unit[at : at + n]
                k = self.ids.get(part)
                if k is not None:
                    found, size = k, n
                if part not in self.begun:
                    break
                n += 1
            out.append(self.unknown if found is None else found)
            at += 1 if found is None else size
        return out


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small vocabulary file through Spark's reader, so that any store serves."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def load_json_bpe(data: bytes) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(ids, merges) of a tokenizers file with a BPE model."""
    model = json.loads(data)["model"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return model["vocab"], merges


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, wire, varint()
        else:
            n = varint() if wire == 2 else 4 if wire == 5 else 8
            yield tag >> 3, wire, data[at : at + n]
            at += n


def load_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a SentencePiece model; type 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
    out = []
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


def score_pieces(pieces: list[tuple[str, float, int]]) -> ScorePieces:
    plain = {p: (i, s) for i, (p, s, k) in enumerate(pieces) if k in (1, 4)}
    raw = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
    unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
    return ScorePieces({p: s for p, (_, s) in plain.items()}, {p: i for p, (i, _) in plain.items()}, raw, unknown)


def token_table(spark: SparkSession, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """(id, piece, score, type, is_control, is_byte): the token attributes as a dimension to join ids with."""
    rows = [(i, p, float(s), int(k)) for i, (p, s, k) in enumerate(pieces)]
    d = spark.createDataFrame(rows, "id int, piece string, score double, type int")
    return d.withColumn("is_control", F.col("type") == 3).withColumn("is_byte", F.col("type") == 6)


#: Rows whose ids are held at once.
SLICE = 128


def _lists(rows: list[array | None]) -> pa.ListArray:
    """A list column of the rows' ids, four bytes each."""
    offsets, flat = [], array("i")
    for r in rows:
        offsets.append(None if r is None else len(flat))
        if r is not None:
            flat.extend(r)
    values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), values)


def encode(d: DataFrame, tokenizer: Tokenizer, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ids (array<int>) of a text column; a null text has null ids."""
    shared = d.sparkSession.sparkContext.broadcast(tokenizer)
    schema = ", ".join(f"{c} {t}" for c, t in d.select(*keep).dtypes) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                ids = [None if (x := v.as_py()) is None else array("i", t.encode(x)) for v in b.column("x_text")]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], _lists(ids)], [*keep, "ids"])

    return d.select(*keep, F.col(text).alias("x_text")).mapInArrow(run, schema)


def detokenize(d: DataFrame, table: DataFrame, key: str, clean: bool = True) -> DataFrame:
    """(key, text) of rows (key, pos, id): ids joined with their pieces and put in order; ``clean`` takes the space off before punctuation."""
    x = d.join(F.broadcast(table.select("id", "piece")) if table.limit(500_001).count() <= 500_000 else table.select("id", "piece"), "id")
    x = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = F.ltrim(F.translate(F.array_join(F.transform("p", lambda s: s["piece"]), ""), "▁", " "))
    return x.select(key, (F.regexp_replace(text, r" ([?.!,])", "$1") if clean else text).alias("text"))


def prefix_pairs(table: DataFrame) -> DataFrame:
    """(a_id, b_id): tokens whose text begins another token's; each text joins the proper prefixes of itself, so no pairs are tried in vain."""
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - 1), lambda n: F.substring(F.col("piece"), F.lit(1), n)))
    b = table.filter(F.length("piece") > 1).select(F.col("id").alias("b_id"), cut.alias("piece"))
    return table.select(F.col("id").alias("a_id"), "piece").join(b, "piece").select("a_id", "b_id")
