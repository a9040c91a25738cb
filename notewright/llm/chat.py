"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks that open it. The lines of level 0, without attribution
lines ("On ... wrote:"), are a message's own text. A passage is a run of neighbouring lines of one level; blank lines end one of
the own text (a paragraph), not a quoted one, which may hold several. Passages, their lines and their sentences, and whole own texts, are normalised
(marks and outer white space off, lower case, inner white space single), so that a passage whose lines were wrapped anew is the same, and
each is hashed. Each quoted unit points to the latest earlier message of the conversation that has it as its own.
A message replies to the one that most of the characters it quotes at level 1 point to, else at the next level; the later one on
ties. A thread's root is found by pointer doubling. A conversation is its threads by root, each in turn
order, so that every message comes after the one it answers.

One row per message comes back; nothing collects a conversation, and no line that many messages hold or quote is paired with all of
them. Positions come from a sort over the whole table, so long conversations and threads are spread over many tasks. Nulls: a null text is an empty one; rows with
a null conv_id or turn take no part in links (a null turn comes last). Repeated rows keep a row each and one
link; distinct rows of the same turn are separate messages, and a link to their turn takes the smallest thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let, store

MARKS = r"^[\x20\x09]*(?:>[\x20\x09]?)+"
ATTRIBUTION = r"(?i)^[\x20\x09]*(on\b.*\bwrote|le\b.*\bécrit|am\b.*\bschrieb.*|el\b.*\bescribió)[\x20\x09]*:[\x20\x09]*$"


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, MARKS, 0), " \t", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Where a sentence ends.
SENTENCE_END = r"(?<=[.!?])\s+"


def _runs(lines: Column, same) -> Column:
    """``lines`` (structs) as an array of runs: a run goes on while ``same(line, the one before)``."""

    def cut(x: Column) -> Column:
        pairs = F.zip_with(x, F.concat(F.array(F.lit(None)), F.slice(x, 1, F.size(x) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        at = F.filter(F.transform(pairs, lambda p, i: F.when(p["b"].isNotNull() & same(p["a"], p["b"]), -1).otherwise(i)), lambda i: i >= 0)
        ends = lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(x))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(let(at, ends), lambda r: F.slice(x, r["a"] + 1, r["b"] - r["a"]))

    return F.when(F.size(lines) > 0, let(lines, cut)).otherwise(F.slice(F.array(lines), 1, 0))


def _units(run: Column) -> Column:
    """A passage (its normalised lines, joined), its lines and its sentences; blank ones are left out."""
    shown = F.filter(run, lambda x: x != "")
    return let(shown, lambda r: F.array_distinct(F.filter(F.concat(F.array(F.array_join(r, " ")), r, F.split(F.array_join(r, " "), SENTENCE_END, -1)), lambda x: x != "")))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Adds own (text without quotes), own_units (of its paragraphs and of the whole), quoted (array of (level, units of a passage)) and n_quoted_lines."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1),
        lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line"), (_level(x) == 0) & x.rlike(ATTRIBUTION) & F.col("text").contains(">")),
    )
    d = messages.withColumn("q_lines", F.filter(lines, lambda x: ~x["col3"]))
    own = F.transform(F.filter("q_lines", lambda x: x["level"] == 0), lambda x: x["line"])
    d = d.withColumn("own", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""))
    d = d.withColumn("q_lines", F.transform("q_lines", lambda x: F.struct(x["level"].alias("level"), normal(x["line"]).alias("line"))))
    blank = lambda x: (x["level"] == 0) & (x["line"] == "")
    d = d.withColumn("q_runs", _runs(F.col("q_lines"), lambda x, y: (x["level"] == y["level"]) & ~blank(x) & ~blank(y)))
    texts = lambda run: F.transform(run, lambda x: x["line"])
    level = lambda run: F.get(run, F.lit(0))["level"]
    paragraphs = F.flatten(F.transform(F.filter("q_runs", lambda run: level(run) == 0), lambda run: _units(texts(run))))
    d = d.withColumn("own_units", F.array_distinct(F.filter(F.concat(F.array(normal(F.col("own"))), paragraphs), lambda x: x != "")))
    quoted = F.transform(F.filter("q_runs", lambda run: level(run) > 0), lambda run: F.struct(level(run).alias("level"), _units(texts(run)).alias("units")))
    d = d.withColumn("quoted", F.filter(quoted, lambda x: F.size(x["units"]) > 0))
    return d.withColumn("n_quoted_lines", F.size(F.filter("q_lines", lambda x: (x["level"] > 0) & (x["line"] != "")))).drop("q_lines", "q_runs")


def _latest_holder(q: DataFrame, o: DataFrame, step: int) -> DataFrame:
    """q (conv_id, q_turn, level, h, m) with o_turn and n of the latest message before q_turn that holds the unit, where there is one.

    Turns are cut into spans of ``step``: the latest holder is in the quoter's own span, else in the last span before it that has
    one, so that no unit is ranked in one task.
    """
    unit = ["conv_id", "h", "m"]
    span = lambda c: F.floor(F.col(c) / step)
    both = q.select(*unit, "level", F.col("q_turn").alias("turn"), F.lit(True).alias("asks"), F.lit(None).cast("int").alias("n"))
    both = both.unionByName(o.select(*unit, F.lit(None).cast("int").alias("level"), F.col("o_turn").alias("turn"), F.lit(False).alias("asks"), "n")).withColumn("span", span("turn"))
    own = Window.partitionBy(*unit, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    held = F.when(~F.col("asks"), F.struct(F.col("turn"), F.col("n")))
    near = both.withColumn("near", F.max(held).over(own)).filter("asks").drop("asks", "n")
    spans = both.groupBy(*unit, "span").agg(F.max(held).alias("top"))
    before = F.last("top", ignorenulls=True).over(Window.partitionBy(*unit).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*unit, "span", before.alias("far"))
    found = near.join(spans, [*unit, "span"]).withColumn("hit", F.coalesce("near", "far")).filter("hit is not null")
    return found.select("conv_id", F.col("turn").alias("q_turn"), "level", F.col("hit.turn").alias("o_turn"), F.col("hit.n").alias("n"))


def _links(msgs: DataFrame, step: int) -> DataFrame:
    """conv_id, turn, parent: for the messages whose quotes are found in an earlier one."""
    quoting = msgs.filter((F.size("quoted") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "quoted")
    convs = quoting.select("conv_id").distinct()
    q = quoting.select("conv_id", F.col("turn").alias("q_turn"), F.inline("quoted")).select("conv_id", "q_turn", "level", F.explode("units").alias("unit"))
    q = q.select("conv_id", "q_turn", "level", F.xxhash64("unit").alias("h"), F.md5("unit").alias("m"))
    o = msgs.filter(F.col("turn").isNotNull()).join(convs, "conv_id", "left_semi")
    o = o.select("conv_id", F.col("turn").alias("o_turn"), F.explode("own_units").alias("unit"))
    o = o.select("conv_id", "o_turn", F.xxhash64("unit").alias("h"), F.md5("unit").alias("m"), F.length("unit").alias("n")).distinct()
    hit = _latest_holder(q.distinct(), o, step).groupBy("conv_id", "q_turn", "level", "o_turn").agg(F.sum("n").alias("n"))
    best = F.max(F.struct(-F.col("level"), F.col("n"), F.col("o_turn"))).alias("b")
    return hit.groupBy("conv_id", "q_turn").agg(best).select("conv_id", F.col("q_turn").alias("turn"), F.col("b.o_turn").alias("parent"))


def _roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth by pointer doubling: as many rounds as the log of the longest chain."""
    at = store(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "chat-roots")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        nxt = at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "parent", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved"))
        was, at = at, store(nxt, "chat-roots")
        discard(was)
        if at.filter("moved").limit(1).count() == 0:
            return at.drop("moved")


def link_quotations(messages: DataFrame, step: int = 1000) -> DataFrame:
    """One row per message in reply order.

    conv_id, position (from 1), turn, role, text (own words, quotes off), parent_turn, thread_turn, depth,
    n_quoted_lines. ``step``: turns in a span of the search for quoted messages.
    """
    d = parse_quotes(messages.select("conv_id", "turn", "role", "text"))
    found = _roots(_links(d, step)).withColumnsRenamed({"conv_id": "r_conv", "turn": "r_turn"})
    d = d.select("conv_id", "turn", "role", "own", "n_quoted_lines")
    d = d.join(found, (F.col("conv_id") == F.col("r_conv")) & (F.col("turn") == F.col("r_turn")), "left")
    d = d.withColumn("thread_turn", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    d = d.select("conv_id", "turn", "role", "own", "parent", "thread_turn", "depth", "n_quoted_lines")
    order = [F.col(c).asc_nulls_last() for c in ("thread_turn", "turn", "role", "own", "n_quoted_lines")]
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(tasks, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    d = store(d, "chat-sorted")  # read twice, and the sort's bounds are drawn anew for each run
    sizes = d.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("conv_id").alias("s_conv"), F.col("part").alias("s_part"), F.coalesce(before, F.lit(0)).alias("offset"))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    d = d.join(sizes, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("part") == F.col("s_part")))
    return d.select("conv_id", (F.col("r") + F.col("offset")).alias("position"), "turn", "role", F.col("own").alias("text"), F.col("parent").alias("parent_turn"), "thread_turn", "depth", "n_quoted_lines")
