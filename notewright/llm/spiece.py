"""SentencePiece encoding and decoding with one forward pass over a trie of marked words.

A text is marked (spaces become U+2581, one more in front) and cut into marked words, across which no piece of the vocabulary reaches:
U+2581 signs with the characters up to the next one or a newline, and, if no piece of the vocabulary mixes the two, up to where
Latin letters and other characters meet. The distinct words of a batch are sorted, which
lays them out as a depth-first walk of their trie, and the forward states of the characters a word shares with the one before are reused.

The forward pass is a Viterbi search over the pieces that end at each character. For a model of type unigram the best sum of
scores wins. For a BPE model the best path is the one that its merges lead to: two pieces may follow one another only if
merging the characters of both gives back the two, which leaves one path to each character; it equals the library's BPE ids
exactly, which sums of the scores (ranks) don't. Characters without a piece become byte pieces, or the unknown piece.

A null text gives null ids; an empty one no ids. Round trips are exact but for texts that hold U+2581 itself (decoded as a
space), as with the library. Normalisers other than identity aren't supported and raise ValueError. Repeated rows are encoded each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MARKED = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: As MARKED, and cut where Latin letters and other characters meet.
LETTERED = re.compile(f"{MARK}*(?:[{LATIN}]+|[^{LATIN}{MARK}\n]+)|{MARK}+|\n")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_WORDS, MOST_PAIRS = 250_000, 250_000


@dataclass
class Pieces:
    """What encoding needs of a model file; small and bounded by the vocabulary, so it goes to the tasks as it is."""

    pieces: list[str]
    scores: list[float]
    plain: dict[str, int]
    bytes_at: int | None
    unknown: int
    bpe: bool
    prefix: bool
    special: frozenset[int] = field(default_factory=frozenset)

    @cached_property
    def ends(self) -> dict[str, int]:
        """Every ending of a piece, with the piece's id if it is a whole one, else -1."""
        out = {p[i:]: -1 for p in self.plain for i in range(1, len(p))}
        return out | self.plain

    @cached_property
    def words(self) -> re.Pattern:
        """How marked texts are cut: a piece reaches over no cut of LETTERED if none of the pieces has one inside."""
        return LETTERED if all(LETTERED.fullmatch(p) for p in self.plain) else MARKED

    @cached_property
    def texts(self) -> list[bytes]:
        """What each id decodes to, marks still in place."""
        out = [b"" if i in self.special else p.encode() for i, p in enumerate(self.pieces)]
        if self.bytes_at is not None:
            out[self.bytes_at : self.bytes_at + 256] = [bytes([b]) for b in range(256)]
        return out


def load(path: str = MODEL) -> Pieces:
    """Reads a .model file with the sentencepiece library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    at = next((i for i in range(n) if sp.is_byte(i)), None)
    plain = {p: i for i, p in enumerate(pieces) if not odd[i] and not sp.is_byte(i)}
    return Pieces(pieces, [sp.get_score(i) for i in range(n)], plain, at, sp.unk_id(), m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix, frozenset(i for i in range(n) if odd[i]))


class Encoder:
    """Encodes marked words; keeps bounded caches of words and of pairs of pieces between batches."""

    def __init__(self, p: Pieces):
        self.p, self.ids, self.pairs, self.odd = p, {}, {}, {}
        self.names = list(p.pieces)
        self.spelled = [np.int32(i).tobytes() for i in range(len(p.pieces))]
        self.low = min((s for s in p.scores if s > -1e8), default=0.0) - 10

    def merged(self, word: str) -> list[str]:
        """BPE by merging: the adjacent pair with the best piece first, the left one on ties."""
        s = list(word)
        while len(s) > 1:
            best, at = -math.inf, -1
            for i in range(len(s) - 1):
                k = self.p.plain.get(s[i] + s[i + 1])
                if k is not None and self.p.scores[k] > best:
                    best, at = self.p.scores[k], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces gives back the two."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        got = self.pairs[a << 24 | b] = self.merged(x + y) == [x, y]
        return got

    def _odd(self, char: str) -> int:
        """The number of a character without a piece: it is spelled in byte pieces, or is the unknown piece."""
        k = self.odd.get(char)
        if k is None:
            k = self.odd[char] = len(self.names)
            self.names.append(char)
            ids = [self.p.bytes_at + b for b in char.encode("utf-8", "replace")] if self.p.bytes_at is not None else [self.p.unknown]
            self.spelled.append(np.array(ids, dtype=np.int32).tobytes())
        return k

    def learn(self, words: set[str]) -> None:
        """Adds the ids of ``words`` to the cache: one walk of their trie in sorted order.

        ``back`` and ``last`` hold, per character, where the best piece that ends there starts, and its number;
        ``best`` the path's score. A character that no piece ends with is a unit of its own, numbered from the size of the vocabulary.
        """
        ends, spelled, scores, bpe, pairs = self.p.ends, self.spelled, self.p.scores, self.p.bpe, self.pairs
        back, last, best = [0], [0], [0.0]
        before = ""
        for w in sorted(words):
            same = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                same += 1
            del back[same + 1 :], last[same + 1 :], best[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                found, s = [], i - 1
                while s >= 0:
                    k = ends.get(w[s:i])
                    if k is None:
                        break
                    if k >= 0:
                        found.append((s, k))
                    s -= 1
                if not found or found[0][0] != i - 1:
                    found.insert(0, (i - 1, self._odd(w[i - 1])))
                if bpe:
                    for at, k in reversed(found):
                        if at == 0:
                            break
                        ok = pairs.get(last[at] << 24 | k)
                        if ok or (ok is None and self.follows(last[at], k)):
                            break
                    back.append(at)
                    last.append(k)
                else:
                    top, at, k = max((best[at] + (scores[k] if k < len(scores) else self.low), -at, k) for at, k in found)
                    back.append(-at)
                    last.append(k)
                    best.append(top)
            before, i, out = w, len(w), []
            while i > 0:
                out.append(spelled[last[i]])
                i = back[i]
            out.reverse()
            self.ids[w] = b"".join(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut, found = [], self.p.words.findall
        for t in texts:
            if t:
                t = t.replace(" ", MARK)
                cut.append(found(MARK + t if self.p.prefix else t))
            else:
                cut.append(None if t is None else [])
        new = set().union(*(c for c in cut if c)) - self.ids.keys()
        if len(self.ids) + len(new) > MOST_WORDS:
            self.ids.clear()
            new = set().union(*(c for c in cut if c))
        self.learn(new)
        get = self.ids.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(get, c)), dtype=np.int32) for c in cut]


def decode_ids(ids, p: Pieces) -> str:
    text = b"".join(map(p.texts.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if p.prefix and text[:1] == " " else text


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    offsets, at = [], 0
    for a in arrays:
        offsets.append(None if a is None else at)
        at += 0 if a is None else len(a)
    values = np.concatenate([a for a in arrays if a is not None and len(a)]) if at else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.array(values, pa.int32()))


def _slices(texts: list[str | None], most_rows: int = 256, most_chars: int = 2_000_000):
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if i + 1 - lo >= most_rows or chars >= most_chars:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text back)."""
    p = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(p)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                ids = e.encode(texts[lo:hi])
                same = [None if a is None else decode_ids(a.tolist(), p) == t for a, t in zip(ids, texts[lo:hi], strict=True)]
                n = [0 if a is None else len(a) for a in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), _lists(ids), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of the ids; null ids give a null text."""
    p = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if a is None else decode_ids(a, p) for a in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
