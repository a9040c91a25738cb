"""String functions: trimming, escapes, stop suffixes, chunks, ranges, labels, rendering to CSV / JSON / Markdown / SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def process_escapes(text: Column) -> Column:
    r"""Turns \n \r \t \' \" \\ and \xHH into their characters; other backslashes stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|\\.|[^\\]+|\\)"), F.lit(1))

    def one(p: Column) -> Column:
        named = F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p == "\\'", "'").when(p == '\\"', '"').when(p == "\\\\", "\\")
        hexed = F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.chr(F.conv(F.substring(p, 3, 2), 16, 10).cast("long")))
        return F.coalesce(named, hexed, p)

    return F.array_join(F.transform(parts, one), "")


def unescape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def partial_stop(text: Column, stop: str) -> Column:
    """Where the text's end begins the stop string, or -1: the longest such ending."""
    hits = [F.when(F.endswith(text, F.lit(stop[:k])), F.length(text) - k) for k in range(len(stop), 0, -1)]
    return F.coalesce(*hits, F.lit(-1))


def chunk_by_separator(text: Column, separator: str, size: int) -> Column:
    """Pieces that end with the separator, joined up to at least ``size`` characters; what is left joins the last chunk."""
    parts = F.split(text, f"(?<={separator})")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc, p):
        now = F.concat(acc["now"], p)
        full = F.length(now) >= size
        return F.struct(F.when(full, F.concat(acc["out"], F.array(now))).otherwise(acc["out"]).alias("out"), F.when(full, F.lit("")).otherwise(now).alias("now"))

    def finish(acc):
        out, rest = acc["out"], acc["now"]
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), rest)))
        return F.when(rest == "", out).when(F.size(out) == 0, F.array(rest)).otherwise(joined)

    return F.aggregate(parts, zero, step, finish)


def int_range(spec: str) -> list[int]:
    """'a', 'a-b', 'a-b+step', 'a-b*factor' and comma lists of them; option lists are driver-side parameters."""
    import re

    out: list[int] = []
    for part in spec.split(","):
        m = re.fullmatch(r"(\d+)(?:-(\d+)(?:([+*])(\d+))?)?", part.strip())
        if not m:
            raise ValueError(f"not a range: {part!r}")
        a, b, op, k = int(m[1]), int(m[2] or m[1]), m[3] or "+", int(m[4] or 1)
        if (op == "*" and (k < 2 or a < 1)) or k < 1:
            raise ValueError(f"range never ends: {part!r}")
        while a <= b:
            out.append(a)
            a = a + k if op == "+" else a * k
    return out


def count_label(n: Column) -> Column:
    """1234567 as 1.2M."""
    return F.when(n >= 1e9, F.concat(F.format_number(n / 1e9, 1), F.lit("B"))).when(n >= 1e6, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when(n >= 1e3, F.concat(F.format_number(n / 1e3, 1), F.lit("K"))).otherwise(n.cast("string"))


def tensor_name(name: Column) -> Column:
    """a#b#c as b."""
    return F.when(name.contains("#"), F.regexp_extract(name, "^[^#]*#([^#]*)#", 1)).otherwise(name)


def csv_line(*cols: Column) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in cols])


def markdown_line(*cols: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), F.lit(" |"))


def insert_statement(table: str, d: DataFrame) -> DataFrame:
    """One SQL INSERT per row."""
    vals = F.concat_ws(", ", *[F.concat(F.lit("'"), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("'"), F.lit("''")), F.lit("'")) for c in d.columns])
    return d.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(d.columns)}) VALUES ("), vals, F.lit(");")).alias("sql"))
