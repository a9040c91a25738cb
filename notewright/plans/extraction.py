"""Running an extraction function over prompts: batched with retries on half the batch, or prompt by prompt with a ledger that a broken run goes on from."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import _open

#: What closes a prompt for each model family.
SUFFIXES = {
    "mistral": "[/INST]",
    "llama3": "<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n\n",
    "phi4": "<|im_end|>\n<|im_start|>assistant<|im_sep|>\n",
    "gemma2": "<end_of_turn>\n<start_of_turn>model\n",
    "qwen": "<|im_end|>\n<|im_start|>assistant\n",
    "R1": "<｜Assistant｜>\n",
}


def prompt_suffix(family: str) -> str:
    if family not in SUFFIXES:
        raise ValueError(f"unknown prompt format {family!r}")
    return SUFFIXES[family]


def extract(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32, prefix: str = "", suffix: str = "") -> DataFrame:
    """(entity, chunk_no, answer, error). ``make`` builds the extractor once per task; a failing batch is halved down to single prompts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()

        def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                return [(a, None) for a in f(texts)]
            except Exception as e:  # noqa: BLE001 - the extractor is the user's
                if len(texts) == 1:
                    return [(None, str(e))]
                half = len(texts) // 2
                return answers(texts[:half]) + answers(texts[half:])

        for pdf in batches:
            got: list[tuple[str | None, str | None]] = []
            texts = [prefix + p.replace("\\n", "\n") + suffix for p in pdf["prompt"]]
            for lo in range(0, len(texts), batch):
                got += answers(texts[lo : lo + batch])
            yield pdf[["entity", "chunk_no"]].assign(answer=[a for a, _ in got], error=[e for _, e in got])

    kinds = dict(prompts.dtypes)
    return prompts.select("entity", "chunk_no", "prompt").mapInPandas(run, f"entity {kinds['entity']}, chunk_no {kinds['chunk_no']}, answer string, error string")


_LEDGER = "key string, answer string, error string, tries int"


def ledger(prompts: DataFrame, path: str) -> DataFrame:
    """(key, answer, error, tries) of the finished prompts under ``path``, one row each; an unknown folder is an empty one."""
    f, base = _open(path)
    f.create_dir(base, recursive=True)
    return prompts.sparkSession.read.schema(_LEDGER).parquet(path).dropDuplicates(["key"])


def extract_resumed(
    prompts: DataFrame, make: Callable[[], Callable[[str], str]], path: str, in_flight: int = 8, flush: int = 16, tries: int = 3, prefix: str = "", suffix: str = "", again: bool = False
) -> DataFrame:
    """(entity, chunk_no, answer, error, tries), with finished prompts kept in ``path`` as soon as they are done.

    A task has ``in_flight`` prompts under way at any time: when one is answered the next goes in, so a slow one holds up no other. After every ``flush`` answers, and at its
    end, it writes them to the ledger as a file of their own, which appears whole or not at all. A run that was broken off, or a task that ran twice, finds them there
    and asks only what is missing: at most ``in_flight`` + ``flush`` answers of a lost task are asked for again. A prompt that fails ``tries`` times is kept with its
    error; ``again`` asks those once more.

    A prompt is known by its entity, number and text: a changed text is a new prompt, repeated rows are asked once and have a row of the result each. A null prompt
    isn't asked and has a null answer. ``path`` is a folder that all executors reach.
    """
    key = F.sha2(F.to_json(F.struct(F.col("entity").cast("string").alias("e"), F.col("chunk_no").cast("string").alias("c"), F.col("prompt").alias("p"), F.lit(prefix).alias("b"), F.lit(suffix).alias("a"))), 256)
    rows = prompts.select("entity", "chunk_no", "prompt", F.when(F.col("prompt").isNotNull(), key).alias("key"))
    done = ledger(prompts, path)
    todo = rows.filter("key is not null").join(done.filter("error is null") if again else done, "key", "left_anti").dropDuplicates(["key"])
    schema = pa.schema([("key", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("tries", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (fs, base) = make(), _open(path)
        held: list[tuple] = []
        asked = 0

        def keep() -> None:
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/_{name}") as s:
                pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema), s)
            fs.move(f"{base}/_{name}", f"{base}/done-{name}.parquet")
            held.clear()

        def ask(k: str, text: str) -> tuple:
            for n in range(1, tries + 1):
                try:
                    return k, f(text), None, n
                except Exception as e:  # noqa: BLE001 - the extractor is the user's
                    last = str(e) or type(e).__name__
            return k, None, last, tries

        waiting = ((k, prefix + p.replace("\\n", "\n") + suffix) for b in batches for k, p in zip(b.column("key").to_pylist(), b.column("prompt").to_pylist(), strict=True))
        with ThreadPoolExecutor(in_flight) as pool:
            under_way: set[Future] = set()
            more = True
            while more or under_way:
                while more and len(under_way) < in_flight:
                    x = next(waiting, None)
                    more = x is not None
                    if more:
                        under_way.add(pool.submit(ask, *x))
                if under_way:
                    ready, under_way = wait(under_way, return_when=FIRST_COMPLETED)
                    held += [r.result() for r in ready]
                    asked += len(ready)
                if len(held) >= flush:
                    keep()
        if held:
            keep()
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], ["asked"])

    todo.select("key", "prompt").mapInArrow(run, "asked long").agg(F.sum("asked")).collect()
    best = prompts.sparkSession.read.schema(_LEDGER).parquet(path).groupBy("key").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), "answer", "error", "tries")).alias("x"))
    return rows.join(best, "key", "left").select("entity", "chunk_no", "x.answer", "x.error", "x.tries")
