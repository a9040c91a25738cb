"""Evaluation inputs: sentence-completion CSV, six-line tasks, binary multiple choice, rows of quantised log-probabilities."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tensor as T

#: A field of the CSV: characters and quoted runs without a comma outside quotes.
_FIELD = r'((?:[^,"]|"[^"]*")*)'
_LINE = f"^{_FIELD},{_FIELD},{_FIELD},{_FIELD},(.*)$"


def winogrande(lines: Column) -> Column:
    """struct<index, first, second, choice1, choice2, answer> of ``index,sentence,choice1,choice2,answer``; null for a damaged line.

    The sentence may be quoted; its first ``_`` is where the choices go.
    """
    part = lambda n: F.regexp_extract(lines, _LINE, n)
    sentence = F.when(F.startswith(part(2), F.lit('"')), F.regexp_replace(part(2), r'^"|"$', "")).otherwise(part(2))
    answer = F.regexp_extract(part(5), r"^\s*([12])(?!\d)", 1)
    whole = F.struct(
        part(1).alias("index"), F.substring_index(sentence, "_", 1).alias("first"), F.regexp_replace(sentence, "^[^_]*_", "").alias("second"),
        part(3).alias("choice1"), part(4).alias("choice2"), answer.cast("int").alias("answer"),
    )
    return F.when(lines.rlike(_LINE) & F.contains(sentence, F.lit("_")) & (answer != ""), whole)


def read_winogrande(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).select(winogrande(F.col("value")).alias("t"))
    return d.filter("t is not null").select("t.*")


def hellaswag(lines: DataFrame) -> DataFrame:
    """(task, context, gold, endings): six lines (n from 0, value) a task: the context, the index of its true ending, four endings."""
    six = lines.groupBy(F.floor(F.col("n") / 6).alias("task")).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("x"))
    at = lambda i: F.get("x", F.lit(i))["value"]
    whole = six.filter(F.size("x") == 6)
    return whole.select("task", at(0).alias("context"), F.trim(at(1)).cast("int").alias("gold"), F.array(*[at(i) for i in range(2, 6)]).alias("endings"))


def multiple_choice(raw: bytes) -> list[tuple]:
    """(task, question, which, no, answer, label) of a binary file: a count, offsets, then a question and two answer lists per task."""
    n = struct.unpack_from("<I", raw, 0)[0]
    starts, base, out = struct.unpack_from(f"<{n}I", raw, 4), 4 + 4 * n, []
    for task, start in enumerate(starts):
        at = base + start

        def text() -> str:
            nonlocal at
            size = struct.unpack_from("<I", raw, at)[0]
            if at + 4 + size > len(raw):
                raise ValueError("truncated data")
            at += 4 + size
            return raw[at - size : at].decode("utf-8", "replace")

        question = text()
        for which in (1, 2):
            count = struct.unpack_from("<I", raw, at)[0]
            at += 4
            answers = [text() for _ in range(count)]
            labels = struct.unpack_from(f"<{count}i", raw, at)
            at += 4 * count
            out += [(task, question, which, i, a, x) for i, (a, x) in enumerate(zip(answers, labels, strict=True))]
    return out


def read_multiple_choice(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every file; a damaged one gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column("content").to_pylist():
                try:
                    rows += multiple_choice(raw)
                except (ValueError, struct.error):
                    continue
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["task", "question", "which", "no", "answer", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "task int, question string, which int, no int, answer string, label int")


def quantise_log_probs(logits: Column) -> Column:
    """struct<scale, low, q>: log-probabilities as 16-bit steps of ``scale`` above ``low``; what lies 16 below the best logit is cut to 0."""
    top = F.array_max(logits)
    ends = F.struct(top.alias("top"), F.greatest(F.array_min(logits), top - 16).alias("least"), F.log(T.sum_rows(F.transform(logits, lambda x: F.exp(x - top)))).alias("lse"))

    def one(e: Column) -> Column:
        scale = (e["top"] - e["least"]) / 65535.0
        q = F.transform(logits, lambda x: F.when((scale > 0) & (x > e["least"]), F.rint((x - e["least"]) / scale).cast("int")).otherwise(0))
        return F.struct(scale.alias("scale"), (e["least"] - e["top"] - e["lse"]).alias("low"), q.alias("q"))

    return T.let(ends, one)


def log_probs(quantised: Column) -> Column:
    return F.transform(quantised["q"], lambda x: quantised["scale"] * x + quantised["low"])
