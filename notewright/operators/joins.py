"""Join helpers: places and running sums over ranges, neighbours in sorted order, positional zip, manifest status, common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: How many rows Spark draws for each range to find the ranges' bounds (three times as many, in fact).
SAMPLED = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def sorted_ranges(d: DataFrame, order: list, name: str) -> DataFrame:
    """``d`` in ranges of ``order`` with x_p, the range's number, written once.

    The bounds of ranges are drawn from a sample anew on each run, so everything that follows must read one table.
    """
    tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return materialise(d.repartitionByRange(tasks, *order).withColumn("x_p", F.spark_partition_id()), name)


def running(d: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (their own row included) of every key in the order, none of them in one task.

    Two levels: within a range of rows, and over the ranges' totals, of which a key has one a range.
    """
    ranges = sorted_ranges(d.withColumns({f"x_{n}": c for n, c in sums.items()}), [*by, *order], "running")
    own = Window.partitionBy(*by, "x_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = ranges.groupBy(*by, "x_p").agg(*[F.sum(f"x_{n}").alias(f"x_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("x_p").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("x_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*[F.col(c).alias(f"x_k{i}") for i, c in enumerate(by)], F.col("x_p").alias("x_q"), *[F.coalesce(F.sum(f"x_t_{n}").over(before), F.lit(0)).alias(f"x_o_{n}") for n in sums])
    got = ranges.withColumns({f"x_{n}": F.sum(f"x_{n}").over(own) for n in sums})
    same = F.col("x_p") == F.col("x_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"x_k{i}"))
    return got.join(offset, same).select(*d.columns, *[(F.col(f"x_{n}") + F.col(f"x_o_{n}")).alias(n) for n in sums])


def with_ordinal(d: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds n: the row's place (from 1) by ``order``, within its key if ``by`` is given."""
    return running(d, by or [], order, {"n": F.lit(1).cast("long")})


def with_neighbours(d: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_ and next_ of ``columns``: those of the rows before and after in the order of the key, null at its ends.

    Neighbours are looked up within ranges; only the first and last row of each range meet across them.
    """
    ranges = sorted_ranges(d, [*by, *order], "neighbours")
    w = Window.partitionBy("x_p").orderBy(*by, *order)
    row = F.struct(*by, *columns)
    got = ranges.withColumns({"x_prev": F.lag(row).over(w), "x_next": F.lead(row).over(w), "x_row": row})
    ends = got.groupBy("x_p").agg(F.max(F.when(F.col("x_prev").isNull(), row)).alias("x_first"), F.max(F.when(F.col("x_next").isNull(), row)).alias("x_last"))
    chain = Window.orderBy("x_p")  # a row for each range
    ends = ends.select(F.col("x_p").alias("x_q"), F.lag("x_last").over(chain).alias("x_before"), F.lead("x_first").over(chain).alias("x_after"))
    got = got.join(F.broadcast(ends), F.col("x_p") == F.col("x_q"))
    got = got.withColumns({"x_prev": F.coalesce("x_prev", "x_before"), "x_next": F.coalesce("x_next", "x_after")})
    same = {"x_prev": F.lit(True), "x_next": F.lit(True)}
    for c in by:
        same = {k: v & F.col(f"{k}.{c}").eqNullSafe(F.col(c)) for k, v in same.items()}
    pick = [F.when(same[f"x_{k}"], F.col(f"x_{k}.{c}")).alias(f"{k}_{c}") for k in ("prev", "next") for c in columns]
    return got.select(*d.columns, *pick)


def ordered_words(text: Column) -> Column:
    """A text whose order as a string is that of its list of words (split at blanks), and from which ``nearest_prefixes`` counts words.

    Words end in NUL, which sorts before all else; the characters 0 and 1 are written as two each, in their order.
    """
    return F.replace(F.replace(F.replace(text, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")), F.lit(" "), F.lit("\x00"))


def shared_words(a: bytes, b: bytes) -> int:
    """How many words two ordered_words begin with alike."""
    most, same, step = min(len(a), len(b)), 0, 64
    while same < most and a[same : same + step] == b[same : same + step]:
        same += step
        step *= 2
    same = min(same, most)
    while step > 1 and same < most:  # the first difference lies within ``step``
        step //= 2
        if a[same : same + step] == b[same : same + step]:
            same = min(same + step, most)
    return a.count(b"\0", 0, same) + (a[same : same + 1] in (b"", b"\0") and b[same : same + 1] in (b"", b"\0"))


def _neighbour_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range's sorted rows (x_by, x_words, id): (x_p, x_first, x_last, x_by, x_words, id, prev, prev_n, next, next_n); words only at the range's ends.

    A row waits for the one behind it; no more than that and a batch are held.
    """
    p, names = TaskContext.get().partitionId(), ("x_p", "x_first", "x_last", "x_by", "x_words", "id", "prev", "prev_n", "next", "next_n")
    shape = pa.schema([("x_p", pa.int32()), ("x_first", pa.bool_()), ("x_last", pa.bool_()), ("x_by", pa.string()), ("x_words", pa.binary()), *[(n, pa.int64()) for n in names[5:]]])
    held, first, link = None, True, (None, None)
    batch = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)
    for b in batches:
        out = []
        for by, words, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held is not None:
                near = held[0] == by and held[1] is not None
                met = near and words is not None
                n = shared_words(held[1], words) if met else held[1].count(b"\0") + 1 if near else None
                out.append((p, first, False, held[0], held[1] if first else None, held[2], *link, i if met else None, n if met else None))
                first, link = False, (held[2] if near else None, n)
            held = by, words, i
        yield batch(out)
    if held is not None:
        yield batch([(p, first, True, *held, *link, None, None)])


def nearest_prefixes(d: DataFrame, by: str, text: str, key: str) -> DataFrame:
    """(key, prev, prev_n, next, next_n): the rows before and after in the order of (words of the text, key) within ``by``, and how many words they begin with alike.

    Texts are shuffled once, as strings; ranges are sorted and read from end to end, and only their first and last texts leave a task.
    Those meet across ranges, an empty range having none. Rows without a text come last and are no neighbours; as in SQL, where least()
    passes over nulls, the first of them is taken to share all words of the row before.
    """
    tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    s = d.select(F.col(by).cast("string").alias("x_by"), F.encode(ordered_words(F.col(text)), "UTF-8").alias("x_words"), F.col(key).cast("long").alias("id"))
    order = ["x_by", F.asc_nulls_last("x_words"), "id"]
    s = s.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    shape = "x_p int, x_first boolean, x_last boolean, x_by string, x_words binary, id long, prev long, prev_n long, next long, next_n long"
    conf = d.sparkSession.conf
    usual = conf.get(SAMPLED)
    conf.set(SAMPLED, str(min(int(usual), 20)))  # whole texts, which pass through the driver
    try:
        s = materialise(s.mapInArrow(_neighbour_prefixes, shape), "prefixes")
    finally:
        conf.set(SAMPLED, usual)
    row, chain = F.struct("x_by", "x_words", "id"), Window.orderBy("x_p")  # a row for each range
    ends = s.filter("x_first or x_last").groupBy("x_p").agg(F.max(F.when(F.col("x_first"), row)).alias("x_f"), F.max(F.when(F.col("x_last"), row)).alias("x_l"))
    ends = ends.select("x_p", "x_f", "x_l", F.lag("x_l").over(chain).alias("x_before"), F.lead("x_f").over(chain).alias("x_after"))

    def meet(a: str, b: str, name: str) -> list[Column]:
        """Of row ``a`` beside row ``b``."""
        x, y = (F.split(F.col(f"{c}.x_words").cast("string"), "\\x00") for c in (a, b))
        near = F.col(b).isNotNull() & F.col(f"{a}.x_by").eqNullSafe(F.col(f"{b}.x_by")) & y.isNotNull()
        n = F.when(x.isNull(), F.size(y)).otherwise(common_prefix(x, y)).cast("long")
        return [F.when(near, F.col(f"{b}.id")).alias(f"x_{name}"), F.when(near, n).alias(f"x_{name}_n")]

    ends = ends.select(F.col("x_p").alias("x_q"), *meet("x_f", "x_before", "prev"), *meet("x_l", "x_after", "next"))
    got = s.join(F.broadcast(ends), F.col("x_p") == F.col("x_q"))
    at = {"prev": F.col("x_first"), "next": F.col("x_last")}
    pick = [F.when(at[n[:4]], F.col(f"x_{n}")).otherwise(F.col(n)).alias(n) for n in ("prev", "prev_n", "next", "next_n")]
    return got.select(F.col("id").alias(key), *pick)


def zip_by_order(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row i of ``a`` beside row i of ``b``; the longer side's rest has no partner."""
    return with_ordinal(a, order_a).join(with_ordinal(b, order_b), "n")


def zip_checked(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """As zip_by_order, but sides of different lengths give no rows (a damaged shard is skipped)."""
    same = a.agg(F.count("*").alias("x_a")).join(b.agg(F.count("*").alias("x_b")), F.col("x_a") == F.col("x_b"), "inner").select(F.lit(1).alias("x_ok"))
    z = zip_by_order(a, b, order_a, order_b).withColumn("x_ok", F.lit(1))
    return z.join(F.broadcast(same), "x_ok", "left_semi").drop("x_ok")


def manifest_status(manifest: DataFrame, files: DataFrame, digest: str) -> DataFrame:
    """``manifest`` with valid / missing flags by digest."""
    got = files.select(F.col(digest).alias("x_d")).distinct()
    return manifest.join(got, manifest[digest] == got["x_d"], "left").withColumn("missing", F.col("x_d").isNull()).withColumn("valid", F.col("x_d").isNotNull()).drop("x_d")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(n)
