"""Answers as keyed streams: pieces of a text go out as soon as they can't be part of a stop string any more.

State of a key is the text held back and whether the answer has ended; both go some time after the last piece (``ttl``). What is held is the longest ending
that begins a stop string, so it is shorter than the longest of them. An answer without pieces for ``idle`` ends by a timer, which says what was held.

Input rows are (key, no, piece); within a micro-batch a key's pieces go in order of ``no``, and a null piece is empty. Pieces behind a stop string
are dropped. Each micro-batch gives a key at most one row: (key, part, finished), finished being ``stop``, ``idle`` or null; a batch that says
nothing gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and time to live need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cut(text: str, stops: list[str]) -> tuple[str, str, bool]:
    """(said, held, ended): what may go out, what may be the beginning of a stop string, and whether one is there. The earliest stop counts."""
    found = [i for i in (text.find(s) for s in stops) if i >= 0]
    if found:
        return text[: min(found)], "", True
    for n in range(min(len(text), max(map(len, stops), default=1) - 1), 0, -1):
        if any(s.startswith(text[-n:]) for s in stops):
            return text[:-n], text[-n:], False
    return text, "", False


class StopStrings(StatefulProcessor):
    def __init__(self, stops: list[str], idle: int | None, ttl: int | None):
        self.stops, self.idle, self.ttl = [s for s in stops if s], idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", "held string, ended boolean", ttlDurationMs=self.ttl)
        self.due = handle.getValueState("due", "at long", ttlDurationMs=self.ttl)

    def _later(self, timers) -> None:
        if self.idle is None:
            return
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        at = timers.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _row(self, key: tuple, part: str, finished: str | None) -> Iterator[pd.DataFrame]:
        if part or finished:
            yield pd.DataFrame({"key": [key[0]], "part": [part], "finished": pd.Series([finished], dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, ended = self.state.get() if self.state.exists() else ("", False)
        pieces = [(n, p or "") for pdf in rows for n, p in zip(pdf["no"].tolist(), pdf["piece"].tolist(), strict=True)]
        if ended:
            return
        text = held + "".join(p for _, p in sorted(pieces, key=lambda x: x[0]))
        part, held, ended = cut(text, self.stops)
        self.state.update((held, ended))
        self._later(timerValues)
        yield from self._row(key, part, "stop" if ended else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, ended = self.state.get() if self.state.exists() else ("", True)
        self.due.clear()
        if ended:
            return
        self.state.update(("", True))
        yield from self._row(key, held, "idle")

    def close(self) -> None:
        pass


def answers(stream: DataFrame, stops: list[str], idle: int | None = None, ttl: int | None = None) -> DataFrame:
    """(key, part, finished) of a stream of (key, no, piece); ``idle`` and ``ttl`` in milliseconds. Keys of any type."""
    kinds = dict(stream.dtypes)
    stream.sparkSession.conf.set(*STORE)
    return stream.select("key", "no", "piece").groupBy("key").transformWithStateInPandas(
        StopStrings(stops, idle, ttl), outputStructType=f"key {kinds['key']}, part string, finished string", outputMode="Append", timeMode="none" if idle is None and ttl is None else "processingTime")
