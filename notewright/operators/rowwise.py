"""Operators of one's own as table functions: the rows of a partition in order, a state of their own, and a declared output shape.

A sampler is a chain of steps; each sees the candidates of a context from the best on and lets them pass, changed or not. No step keeps more than
a few numbers, so a context of any size streams through one task without being gathered. ``row_sampler`` takes the built-in steps by name, or any factory of
objects with ``step(id, logit) -> logit or None``. ``custom_op`` wraps a function of a row and a state.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class TopK:
    def __init__(self, k: int):
        self.left = k

    def step(self, token, logit):
        self.left -= 1
        return logit if self.left >= 0 else None


class MinP:
    """Those with at least p times the best one's probability; the first always."""

    def __init__(self, p: float):
        self.p, self.least = p, None

    def step(self, token, logit):
        if self.least is None:
            self.least = logit + math.log(self.p)
        return logit if logit >= self.least else None


class Temperature:
    def __init__(self, t: float):
        self.t = t

    def step(self, token, logit):
        return logit / self.t


class Bias:
    """Adds to the logits of some ids; as it may change the order, it goes last."""

    def __init__(self, bias: dict):
        self.bias = bias

    def step(self, token, logit):
        return logit + self.bias.get(token, 0.0)


STEPS: dict[str, Callable] = {"top_k": TopK, "min_p": MinP, "temperature": Temperature, "logit_bias": Bias}


def row_sampler(*steps: tuple[str, object] | Callable):
    """A table function of (ctx, id, logit) that passes each context, best first (smaller id on ties), through fresh steps."""
    made = [s if callable(s) else (lambda s=s: STEPS[s[0]](s[1])) for s in steps]

    @udtf
    class Sampler:
        def __init__(self):
            self.steps = [m() for m in made]

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            shape = {f.name: f for f in rows.dataType}
            if not {"ctx", "id", "logit"} <= set(shape):
                raise ValueError("a sampler wants the columns ctx, id and logit")
            out = StructType([shape[c] for c in ("ctx", "id", "logit")])
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("ctx")], orderBy=[OrderingColumn("logit", ascending=False), OrderingColumn("id")])

        def eval(self, row):
            logit = row["logit"]
            for s in self.steps:
                if logit is None:
                    return
                logit = s.step(row["id"], logit)
            if logit is not None:
                yield row["ctx"], row["id"], logit

    return Sampler


def sample(candidates: DataFrame, *steps: tuple[str, object] | Callable) -> DataFrame:
    """(ctx, id, logit) of the candidates that pass the steps; null logits don't."""
    return row_sampler(*steps)(candidates.select("ctx", "id", F.col("logit").cast("double").alias("logit")).asTable())


def custom_op(f: Callable, returns: str, by: list[str], order: list[str] | None = None, start: Callable = dict, end: Callable | None = None):
    """A table function: ``f(state, row)`` yields tuples of the shape ``returns`` for each row of a partition ``by``, in ``order``; ``end(state)`` those behind the last."""
    shape = StructType.fromDDL(returns)

    @udtf
    class Op:
        def __init__(self):
            self.state = start()

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn(c) for c in by], orderBy=[OrderingColumn(c) for c in order or []])

        def eval(self, row):
            yield from f(self.state, row)

        def terminate(self):
            if end is not None:
                yield from end(self.state)

    return Op
