"""Sources and sinks of the note programs: headerless CSV, id lists, paired shards, answers, prompts; benchmark rows in four formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTE_COLUMNS = ["PatientICN", "EntryDateTime", "TIUDocumentSID", "ReportText"]
LINKED_COLUMNS = ["SurgicalPathologySID", "InputText"]


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv_positional(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless CSV of strings with embedded newlines; a byte-order mark goes, extra fields are cut, missing ones are null."""
    d = spark.read.schema(_strings(names)).csv(path, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return d.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(entity, row_no, day, doc_id, text): day is null where the date is the text NULL; a malformed date is an error."""
    d = read_csv_positional(spark, path, NOTE_COLUMNS)
    day = F.to_date(F.to_timestamp(F.nullif(F.col("EntryDateTime"), F.lit("NULL")), "yyyy-MM-dd HH:mm:ss"))
    return d.select(F.col("PatientICN").alias("entity"), F.monotonically_increasing_id().alias("row_no"), day.alias("day"), F.col("TIUDocumentSID").alias("doc_id"), F.col("ReportText").alias("text"))


def read_ids(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """(id): one per line, stripped."""
    d = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("id"))
    return d if keep_blank else d.filter("id <> ''")


def only_ids(d: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is listed."""
    return d.join(ids, d[column] == ids["id"], "left_semi")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(answer, id) of a TSV of escaped answers, newlines restored."""
    d = spark.read.schema("answer string, id string").csv(path, sep="\t", quote="", header=False)
    return d.withColumn("answer", F.replace("answer", F.lit("\\n"), F.lit("\n")))


def write_answers(d: DataFrame, path: str) -> None:
    d.select(F.replace("answer", F.lit("\n"), F.lit("\\n")).alias("answer"), "id").write.option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_prompts(d: DataFrame, path: str) -> None:
    """Two text folders, prompts and ids, from one frame in one order: line i of one belongs to line i of the other."""
    one = d.select("prompt", "entity").repartitionByRange(8, "entity").sortWithinPartitions("entity", "prompt")
    one.select("prompt").write.text(f"{path}/input")
    one.select(F.col("entity").alias("value")).write.text(f"{path}/ids")


BENCH_STRINGS = "build_commit cpu_info gpu_info backends model_filename model_type cpu_mask type_k type_v split_mode tensor_split tensor_buft_overrides test_time".split()
BENCH_LONGS = (
    "build_number model_size model_n_params n_batch n_ubatch n_threads cpu_strict poll n_gpu_layers main_gpu no_kv_offload flash_attn use_mmap embeddings no_op_offload n_prompt n_gen n_depth avg_ns stddev_ns"
).split()
BENCH_DOUBLES = "defrag_thold avg_ts stddev_ts".split()
BENCH_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in BENCH_STRINGS] + [T.StructField(n, T.LongType()) for n in BENCH_LONGS] + [T.StructField(n, T.DoubleType()) for n in BENCH_DOUBLES]
)


def read_sqlite(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of SQLite files as strings, read by Python's own library from what Spark's reader brings; no driver on the class path is needed."""
    import sqlite3
    from collections.abc import Iterator

    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("content")

    def columns(raw: bytes) -> list[str]:
        with sqlite3.connect(":memory:") as c:
            c.deserialize(raw)
            return [r[1] for r in c.execute(f'PRAGMA table_info("{name}")')]

    names = columns(bytes(files.first()["content"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                with sqlite3.connect(":memory:") as c:
                    c.deserialize(raw)
                    rows = c.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM \"{name}\"").fetchall()
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in col], pa.string()) for col in cols], names)

    return files.mapInArrow(run, _strings(names))


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows by extension: .json (array), .jsonl, .csv (header); unknown columns go, missing required ones raise ValueError."""
    if path.endswith(".jsonl"):
        d = spark.read.json(path)
    elif path.endswith(".json"):
        d = spark.read.json(path, multiLine=True)
    elif path.endswith(".csv"):
        d = spark.read.csv(path, header=True, quote='"', escape='"')
    elif path.endswith((".sqlite", ".db")):
        d = read_sqlite(spark, path, "test")
    else:
        raise ValueError(f"no reader for {path}")
    missing = {"build_commit", "test_time", "avg_ts"} - set(d.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    flag = lambda c, t: F.when(c.cast("string").isin("true", "false"), (c.cast("string") == "true").cast("int").cast(t)).otherwise(c.cast("string").try_cast(t))
    kinds = {f.name: f.dataType.simpleString() for f in BENCH_SCHEMA}
    return d.select(*[(F.col(n) if k == "string" else flag(F.col(n), k)).alias(n) for n, k in kinds.items() if n in d.columns])
