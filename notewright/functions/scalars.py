"""Scalar functions of text: UTF-8, normalisation, identifiers, numbers in words, file names, time stamps. JVM expressions but where noted."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"))


def valid_utf8(raw: Column) -> Column:
    """Whether a binary column holds UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))


def code_points(text: Column) -> Column:
    """The characters of a text, one string each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


@pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition; the JVM has no SQL function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))


def category(c: Column) -> Column:
    """Class of one character: number, letter, separator, accent mark, punctuation, symbol or control."""
    kinds = {"number": r"^\p{N}$", "letter": r"^\p{L}$", "separator": r"^\p{Z}$", "accent_mark": r"^\p{M}$", "punctuation": r"^\p{P}$", "symbol": r"^\p{S}$", "control": r"^\p{C}$"}
    out = None
    for name, pattern in kinds.items():
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Texts that still have bytes; with fewer, a plain loop for each is faster than steps over all.
FEW = 32


def _fnv1a(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the texts ``data[start : start + size]``: byte j of all that have one in one step, the longest texts' ends one by one."""
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    h, prime = np.full(len(order), FNV_START, np.uint64), np.uint64(FNV_PRIME)
    ending = np.searchsorted(-left, -np.arange(1, (left[FEW] if len(left) > FEW else 0) + 1), side="right")
    for j, m in enumerate(ending.tolist()):
        h[:m] ^= data[at[:m] + j]
        h[:m] *= prime
    done = len(ending)
    for i in range(min(FEW, len(left))):
        x = int(h[i])
        for octet in data[at[i] + done : at[i] + left[i]].tobytes():
            x = (x ^ octet) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


@arrow_udf(StringType())
def _fnv1a_hex(raw: pa.Array) -> pa.Array:
    """Each byte's state needs the one before, which an expression can only do by a row's array of bytes."""
    width = np.int64 if pa.types.is_large_binary(raw.type) else np.int32
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, width)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    got = _fnv1a(np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends))
    return pa.array([f"{x:016x}" if ok else None for x, ok in zip(got.tolist(), raw.is_valid().to_pylist(), strict=True)], pa.string())


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hexadecimal digits, in Arrow batches."""
    return _fnv1a_hex(F.encode(text, "UTF-8"))


def random_id(seed: str, *keys: Column, length: int = 32) -> Column:
    """A repeatable identifier of letters and digits."""
    made = F.base64(F.unhex(F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)))
    return F.substring(F.translate(made, "+/=", "xQ7"), 1, length)


#: Fixed value: the name space of URLs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID in the name space of URLs: SHA-1 with version 5 and the variant's two bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def below_thousand(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    rest, ten = n % 100, F.floor((n % 100) / 10).cast("int")
    two = F.when(rest < 20, F.get(ones, rest)).when(rest % 10 == 0, F.get(tens, ten)).otherwise(F.concat_ws("-", F.get(tens, ten), F.get(ones, rest % 10)))
    hundreds = F.concat(F.get(ones, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, two).when(rest == 0, hundreds).otherwise(F.concat_ws(" ", hundreds, two))


def number_words(n: Column) -> Column:
    """A whole number from 0 to 10^12 - 1 in English words."""
    parts = []
    for size, name in SCALES:
        k = (F.floor(n / size) % 1000).cast("int")
        parts.append(F.when(k > 0, F.concat(below_thousand(k), F.lit(f" {name}"))))
    last = (n % 1000).cast("int")
    parts.append(F.when((last > 0) | (n == 0), below_thousand(last)))
    return F.concat_ws(" ", *parts)


def valid_filename(name: Column) -> Column:
    """Safe as a file name anywhere: 1 to 255 bytes, no control or reserved characters, no blank or dot at its ends, no ``..``."""
    bad = r"""[\x00-\x1F\x7F\x80-\x9F/\\:*?"<>|\x{2044}\x{2215}\x{2216}\x{FEFF}\x{FFFD}\x{FF0E}]"""
    size = F.octet_length(name).between(1, 255)
    return F.coalesce(size & ~name.rlike(bad) & ~name.rlike(r"^ | $|\.$|\.\.|^\.$"), F.lit(False))


def sortable_timestamp(ts: Column) -> Column:
    """yyyy_MM_dd-HH_mm_ss.nanoseconds, which sorts as time does."""
    ts = ts.cast("timestamp")
    return F.concat(F.date_format(ts, "yyyy_MM_dd-HH_mm_ss"), F.lit("."), F.lpad((F.unix_micros(ts) % 1_000_000 * 1000).cast("string"), 9, "0"))


def byte_runs(text: Column) -> Column:
    """Texts cleaned for speech: lower case, numbers spelled by digit groups left alone, everything but letters as one separator."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s]", ""), r"\s+", "<|text_sep|>")
