"""Fill-in-middle: a text cut at two token boundaries into prefix, middle and suffix, written in one of two orders.

Tokens are runs of letters and single other characters. One byte for each code point is mapped to a letter mask by
bytes.translate; read as one big integer with the first character lowest, ``letters & letters << 1`` marks letters that continue a token,
so the other bits are the tokens' starts. bit_count gives their number n, and the start of the k-th is found by halving: the count of
the lower half says in which half it lies. The work is linear in the text, with a few integers of an eighth of its length.

The two cuts and the form come from the SHA-256 of ``seed:doc_id``, so reruns agree and no state is needed.

A null text is an empty one; empty texts, and texts that hold a marker, stay plain. A null doc_id hashes as an empty string. Repeated rows give
equal results. doc_id passes unchanged, whatever its type. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of prefix, suffix and middle.
P, S, M = "<P>", "<S>", "<M>"
_LETTER = bytes(0x31 if chr(b).isascii() and chr(b).isalpha() else 0x30 for b in range(256))


def starts(text: str) -> int:
    """Bit i says whether a token starts at code point i."""
    if not text:
        return 0
    letters = int(text.encode("latin-1", "replace")[::-1].translate(_LETTER), 2)
    return ((1 << len(text)) - 1) & ~(letters & letters << 1)


def ranked(bits: int, k: int, size: int) -> int:
    """The place of the k-th set bit (from 0) of ``bits``, all of which lie under ``size``; ``size`` if there are no more than k."""
    if k >= bits.bit_count():
        return size
    at, width = 0, size
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, width, at, k = bits >> half, width - half, at + half, k - n
    return at


def cut(text: str, key: str, plain_percent: int = 10, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``key`` is what its choices are hashed from."""
    bits = starts(text)
    n = bits.bit_count()
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or h3 % 100 >= 100 - plain_percent or P in text or S in text or M in text:
        return n, "plain", None, None, text
    a, b = (ranked(bits, k, len(text)) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the whole text in its new order)."""
    of_id = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("f_key"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few hundred rows at a time: long texts and their outputs aren't held for a whole batch twice.
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                got = [cut(t, k, plain_percent, spm_percent) for t, k in zip(part.column("text").to_pylist(), part.column("f_key").to_pylist(), strict=True)]
                cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {of_id}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a marker, so each is found at its first place."""
    after = lambda text, part: F.substring(text, F.length(part) + 4, F.length(text))
    body = F.substring(output, F.lit(4), F.length(output))
    first = lambda mark: F.substring_index(body, mark, 1)
    rest = F.when(form == "psm", after(body, first(S))).otherwise(after(body, first(P)))
    second = F.substring_index(rest, M, 1)
    middle = after(rest, second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first(S), middle, second)).otherwise(F.concat(second, middle, first(P)))


def digests(made: DataFrame) -> DataFrame:
    """The sizes of ``transform`` with SHA-256 of its outputs and of the texts rebuilt from them."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
