"""Order statistics by distributed selection: histogram passes narrow the interval that holds a rank, for a group of any size.

A pass counts the rows of every open interval in ``BINS`` bins, with each bin's least and largest value; the bin that holds the rank
becomes the next interval, whose ends are values that are there. An interval of at most ``FEW`` rows
is sorted. No task gathers more than that of a group, where a percentile aggregate keeps all its distinct values.

Null values take no part; NaN is the largest value, as in Spark's order. Null keys are a group. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise

BINS = 1024
FEW = 65_536
#: Intervals up to which they are broadcast.
SMALL = 50_000


def _few(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.limit(SMALL + 1).count() <= SMALL else d


def _same(a: list[str], b: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def _signed_log(x: Column) -> Column:
    """Rises with x over all finite doubles: the sign times the binary logarithm, moved over 0 for the smallest one."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1080))


def _at(part: Column, bins: int) -> Column:
    return F.least(F.floor(part * bins).cast("int"), F.lit(bins - 1))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1, of low < high: equal widths within a factor of two, else of the signed logarithm.

    So a few passes reach any rank, however long the tails: two at the most by logarithms, then each takes a factor of ``bins`` off 52 bits.
    """
    log = (_signed_log(x) - _signed_log(low)) / (_signed_log(high) - _signed_log(low))
    part = F.when(_signed_log(high) - _signed_log(low) > 1, log).otherwise((x - low) / (high - low))
    return _at(part, bins)


def order_statistics(rows: DataFrame, by: list[str], wanted: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, rank, x): the value at each rank (from 0, ascending) of ``wanted`` (by, rank), of stored ``rows`` (by, x double, no nulls)."""
    keys = [f"w_{c}" for c in by]
    finite = ~F.isnan("x") & (F.abs("x") != float("inf"))
    inside = lambda c: F.when(finite, c)
    base = rows.groupBy(*by).agg(
        F.count_if(F.col("x") == float("-inf")).alias("n_low"), F.count_if(finite).alias("n_in"), F.count_if(F.col("x") == float("inf")).alias("n_high"),
        F.min(inside(F.col("x"))).alias("low"), F.max(inside(F.col("x"))).alias("high"),
    )
    w = wanted.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("rank").cast("long").alias("rank")).distinct()
    first = w.join(base, _same(keys, by))
    r, a, b = F.col("rank"), F.col("n_low"), F.col("n_low") + F.col("n_in")
    edge = F.when(r < a, float("-inf")).when(r < b, F.when(F.col("low") == F.col("high"), F.col("low"))).when(r < b + F.col("n_high"), float("inf")).otherwise(float("nan"))
    state = materialise(first.select(*keys, "rank", F.col("n_low").alias("below"), F.col("n_in").alias("held"), "low", "high", edge.alias("x")), "selection")
    done = [state.filter("x is not null").select(*keys, "rank", "x")]
    while True:
        open_ = state.filter("x is null")
        left = open_.agg(F.count("*"), F.max("held")).collect()[0]
        if not left[0]:
            break
        intervals = open_.select(*keys, "low", "high", "held").distinct()
        inner = rows.join(_few(intervals), _same(by, keys) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        at = [*keys, "low", "high"]
        on = _same(keys, [f"h_{k}" for k in keys]) & (F.col("low") == F.col("h_low")) & (F.col("high") == F.col("h_high"))
        if left[1] <= few:
            held = inner.groupBy(*at).agg(F.sort_array(F.collect_list("x")).alias("xs")).select(*[F.col(c).alias(f"h_{c}") for c in at], "xs")
            done.append(open_.join(held, on).select(*keys, "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
            break
        counted = inner.withColumn("bin", _bin(F.col("x"), F.col("low"), F.col("high"), bins)).groupBy(*at, "bin").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*at).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("upto", upto).select(*[F.col(c).alias(f"h_{c}") for c in at], "n", "least", "most", "upto")
        rank = F.col("rank") - F.col("below")
        nxt = open_.join(counted, on & (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
        value = F.when(F.col("least") == F.col("most"), F.col("least"))
        nxt = nxt.select(*keys, "rank", (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("held"), F.col("least").alias("low"), F.col("most").alias("high"), value.alias("x"))
        state = materialise(nxt, "selection")
        done.append(state.filter("x is not null").select(*keys, "rank", "x"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "rank", "x")


def percentiles(d: DataFrame, by: list[str], value: str | Column, points: list[float], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, n, points): the linearly interpolated percentiles of each group, an array in the order of ``points`` (0 to 1).

    A group without values has no row.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = materialise(d.select(*by, x.cast("double").alias("x")).filter("x is not null"), "selection-rows")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)])
    at = sizes.select(*by, "n", F.inline(each)).withColumn("place", F.col("p") * (F.col("n") - 1))
    at = at.select(*by, "n", "i", F.floor("place").alias("r0"), F.ceil("place").alias("r1"), (F.col("place") - F.floor("place")).alias("part"))
    at = materialise(at, "selection-points")
    found = materialise(order_statistics(rows, by, at.select(*by, F.explode(F.array("r0", "r1")).alias("rank")), bins, few), "selection-found")
    discard(rows)
    side = lambda s: found.select(*[F.col(c).alias(f"{s}_{c}") for c in by], F.col("rank").alias(f"{s}_rank"), F.col("x").alias(f"{s}_x"))
    on = lambda s, r: _same(by, [f"{s}_{c}" for c in by]) & (F.col(r) == F.col(f"{s}_rank"))
    both = at.join(_few(side("a")), on("a", "r0")).join(_few(side("b")), on("b", "r1"))
    v = F.when(F.col("a_x") == F.col("b_x"), F.col("a_x")).otherwise(F.col("a_x") * (1 - F.col("part")) + F.col("b_x") * F.col("part"))
    out = both.groupBy(*by, "n").agg(F.sort_array(F.collect_list(F.struct("i", v.alias("v")))).alias("s"))
    return out.select(*by, "n", F.transform("s", lambda s: s["v"]).alias("points"))


def at_least_kth(d: DataFrame, by: str, value: str, k: int, bins: int = 128) -> DataFrame:
    """The rows of each group from the bucket on that holds its k-th largest value: all of the k best and few more, without a sort.

    Lazy: least and largest value, counts by bucket, and a bound for each group; rows whose value is null or NaN stay.
    """
    known = d.filter(F.col(value).isNotNull() & ~F.isnan(value))
    ends = known.groupBy(F.col(by).alias("b_by")).agg(F.min(value).alias("b_low"), F.max(value).alias("b_high"))
    wide = (F.col("b_high") > F.col("b_low")) & (F.abs("b_high") < float("inf")) & (F.abs("b_low") < float("inf"))
    halves = [F.col(c).cast("double") / 2 for c in (value, "b_low", "b_high")]  # the width of two doubles can be beyond them
    bucket = F.when(wide, _at(F.coalesce(F.try_divide(halves[0] - halves[1], halves[2] - halves[1]), F.lit(0.0)), bins)).otherwise(0)
    binned = known.select(F.col(by).alias("g_by"), value).join(_few(ends), F.col("g_by").eqNullSafe(F.col("b_by"))).groupBy("g_by", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least"))
    above = F.sum("n").over(Window.partitionBy("g_by").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bound = binned.withColumn("above", above).filter(F.col("above") < k).groupBy("g_by").agg(F.min("least").alias("x_bound"))
    kept = d.join(_few(bound), F.col(by).eqNullSafe(F.col("g_by")), "left").filter(F.col("x_bound").isNull() | F.col(value).isNull() | (F.col(value) >= F.col("x_bound")))
    return kept.select(*d.columns)
