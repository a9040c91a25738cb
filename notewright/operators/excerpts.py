"""Excerpt pipeline: notes -> pattern hits -> merged context blocks -> de-duplicated, bounded excerpts -> one prompt per entity.

Notes are rows (entity, row_no, day, text): ``row_no`` is the file order, ``day`` a date or null. Every stage is a
DataFrame transformation; notes without a hit are dropped by a pushed-down ``rlike`` before anything is exploded.

Divergences, all deliberate: a hit on the last line is kept (the end of the text ends a line); a random choice is an order by
``md5(seed|entity|excerpt)``, so that reruns agree; white space and case folding follow Java's regular expressions and ``lower``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Entities up to which their note counts are broadcast.
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class ExcerptSpec:
    """Parameters of one extraction program."""

    pattern: str
    before: int
    after: int
    limit: int
    recent: int
    distant: int = 0
    blocks_per_note: int = 15
    before_few: int | None = None  # context for entities with at most ``few_notes`` notes
    few_notes: int = 0
    day_format: str = "yyyy-MM"
    label: str = "YYYY-MM"
    dedup: bool = True
    exclude: str | None = None
    priority: str | None = None
    question: str = ""
    chunk: bool = False  # one row per ``limit`` excerpts in place of a selection
    keep_empty: bool = False  # an entity whose every block was excluded is asked all the same
    seed: str = "notewright"


def normalize_newlines(text: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def note_counts(notes: DataFrame) -> DataFrame:
    """Adds n_notes: all notes of the entity, counted before any filter.

    The count reads the entity column alone; texts stay where they are when the counts are few enough to broadcast.
    """
    n = notes.groupBy(F.col("entity").alias("x_entity")).agg(F.count("*").alias("n_notes"))
    n = F.broadcast(n) if n.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else n
    return notes.join(n, F.col("entity").eqNullSafe(F.col("x_entity"))).drop("x_entity")


def match_spans(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, gaps): leftmost non-overlapping matches and the texts between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def match_offsets(d: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Adds hits: array of (start, end, first_line, last_line); offsets in code points, lines from 0.

    One fold over matches and gaps, linear in the text.
    """
    m, g = match_spans(F.col(text), pattern)
    d = d.filter(F.col(text).rlike(pattern)).withColumn("x_m", m).withColumn("x_g", g)
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    kind = "array<struct<start:int,end:int,first_line:int,last_line:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        start, line = acc["at"] + F.length(x["g"]), acc["line"] + newlines(x["g"])
        body = F.substring(x["m"], F.lit(1), F.greatest(F.length(x["m"]) - 1, F.lit(0)))
        hit = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), line.alias("first_line"), (line + newlines(body)).alias("last_line"))
        return F.struct((start + F.length(x["m"])).alias("at"), (line + newlines(x["m"])).alias("line"), F.concat(acc["out"], F.array(hit)).alias("out"))

    pairs = F.zip_with("x_m", F.slice("x_g", 1, F.size("x_m")), lambda a, b: F.struct(a.alias("m"), b.alias("g")))
    return d.withColumn("hits", F.aggregate(pairs, zero, step, lambda acc: acc["out"])).drop("x_m", "x_g")


def match_lines(d: DataFrame, pattern: str) -> DataFrame:
    """(columns of ``d`` but text, line): the distinct lines that a match touches."""
    keep = [c for c in d.columns if c != "text"]
    lines = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["first_line"], h["last_line"]))))
    return match_offsets(d, pattern).select(*keep, F.explode(lines).alias("line"))


def line_offsets(d: DataFrame) -> DataFrame:
    """One row per line: line (from 0), start offset, text of the line. Running sums stay within a note."""
    keep = [c for c in d.columns if c != "text"]
    lines = F.split("text", "\n", -1)
    x = d.select(*keep, F.posexplode(lines).alias("line", "line_text"))
    w = Window.partitionBy("entity", "row_no").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("start", F.coalesce(F.sum(F.length("line_text") + 1).over(w), F.lit(0)))


def merge_blocks(d: DataFrame, spec: ExcerptSpec) -> DataFrame:
    """Adds blocks: array of (start, end) line ranges, end inclusive; the first ``blocks_per_note`` by position.

    A line joins the open block when it is at most before + 2 * after lines past the block's last hit.
    """
    few = spec.before if spec.before_few is None else spec.before_few
    before = F.when(F.col("n_notes") <= spec.few_notes, F.lit(few)).otherwise(F.lit(spec.before))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["first_line"], h["last_line"])))))
    d = d.withColumn("x_before", before).withColumn("x_lines", lines)
    gap = F.col("x_before") + 2 * spec.after
    first = F.filter("x_lines", lambda x, i: F.coalesce(x - F.get("x_lines", i - 1) > gap, F.lit(True)))
    last = F.filter("x_lines", lambda x, i: F.coalesce(F.get("x_lines", i + 1) - x > gap, F.lit(True)))
    ranges = F.zip_with(first, last, lambda a, b: F.struct(F.greatest(a - F.col("x_before"), F.lit(0)).alias("start"), F.least(b + spec.after, F.col("n_lines")).alias("end")))
    return d.withColumn("blocks", F.slice(ranges, 1, spec.blocks_per_note)).drop("x_before", "x_lines")


def blocks(notes: DataFrame, spec: ExcerptSpec) -> DataFrame:
    """(entity, row_no, day, block_no, start, end, excerpt): one row per merged block of a dated note."""
    d = note_counts(notes) if spec.few_notes else notes.withColumn("n_notes", F.lit(1).cast("long"))
    d = d.filter("day is not null").withColumn("text", normalize_newlines(F.col("text")))
    d = match_offsets(d, spec.pattern).withColumn("x_split", F.split("text", "\n", -1)).withColumn("n_lines", F.size("x_split"))
    d = merge_blocks(d, spec)
    d = d.select("entity", "row_no", "day", "x_split", F.posexplode_outer("blocks").alias("block_no", "b"))
    text = F.array_join(F.slice("x_split", F.col("b.start") + 1, F.col("b.end") - F.col("b.start") + 1), "\n")
    return d.select("entity", "row_no", "day", "block_no", F.col("b.start").alias("start"), F.col("b.end").alias("end"), text.alias("excerpt"))


def dedup_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def first_wins(b: DataFrame) -> DataFrame:
    """Of an entity's blocks with one text (up to case and outer white space) the first in file order."""
    w = Window.partitionBy("entity", dedup_key(F.col("excerpt"))).orderBy("row_no", "block_no")
    return b.withColumn("x_r", F.row_number().over(w)).filter("x_r = 1").drop("x_r")


def excerpts(notes: DataFrame, spec: ExcerptSpec) -> DataFrame:
    """(entity, row_no, block_no, day_label, excerpt, rendered, is_priority) after exclusion and de-duplication."""
    b = blocks(notes, spec)
    if spec.exclude:
        b = b.filter(~F.col("excerpt").rlike(spec.exclude))
    if spec.dedup:
        b = first_wins(b)
    b = b.withColumn("day_label", F.date_format("day", spec.day_format))
    b = b.withColumn("is_priority", F.col("excerpt").rlike(spec.priority) if spec.priority else F.lit(False))
    head = F.concat(F.lit(f"\n<<<\nNote date ({spec.label}): "), F.col("day_label"), F.lit("\nNote text:\n"))
    return b.select("entity", "row_no", "block_no", "day_label", "excerpt", F.concat(head, F.col("excerpt"), F.lit("\n>>>\n")).alias("rendered"), "is_priority")


def select_bounded(e: DataFrame, spec: ExcerptSpec) -> DataFrame:
    """The excerpts an entity keeps: all up to ``limit``; else priority, recent and distant ones and a seeded choice.

    With priorities the four cases are: fill up from the middle; exactly full; too many, then a choice of recent and distant
    beside all priorities; more priorities than the limit, then a choice of those alone.
    """
    lot = Window.partitionBy("entity")
    tier = Window.partitionBy("entity", "is_priority")
    d = e.withColumn("x_n", F.count("*").over(lot)).withColumn("x_p", F.sum(F.col("is_priority").cast("int")).over(lot))
    d = d.withColumn("x_up", F.row_number().over(tier.orderBy("rendered", "row_no", "block_no"))).withColumn("x_m", F.col("x_n") - F.col("x_p"))
    end = (~F.col("is_priority")) & ((F.col("x_up") <= spec.distant) | (F.col("x_up") > F.col("x_m") - spec.recent))
    d = d.withColumn("x_kind", F.when(F.col("is_priority"), 0).when(end, 1).otherwise(2))
    d = d.withColumn("x_e", F.sum((F.col("x_kind") == 1).cast("int")).over(lot))
    dice = F.md5(F.concat_ws("|", F.lit(spec.seed), F.col("entity"), F.col("rendered")))
    d = d.withColumn("x_lot", F.row_number().over(Window.partitionBy("entity", "x_kind").orderBy(dice, "row_no", "block_no")))
    full = F.col("x_p") + F.col("x_e")
    keep = (
        F.when(F.col("x_n") <= spec.limit, F.lit(True))
        .when(full <= spec.limit, (F.col("x_kind") < 2) | (F.col("x_lot") <= spec.limit - full))
        .when(F.col("x_p") < spec.limit, (F.col("x_kind") == 0) | ((F.col("x_kind") == 1) & (F.col("x_lot") <= spec.limit - F.col("x_p"))))
        .otherwise((F.col("x_kind") == 0) & (F.col("x_lot") <= spec.limit))
    )
    return d.filter(keep).drop("x_n", "x_p", "x_m", "x_up", "x_kind", "x_e", "x_lot")


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def prompts(notes: DataFrame, spec: ExcerptSpec) -> DataFrame:
    """(entity, chunk_no, n_excerpts, prompt): rendered, sorted, with the question, newlines escaped.

    Excerpts per row are bounded by ``limit``, in the chunked form too.
    """
    e = excerpts(notes, spec)
    if spec.chunk:
        w = Window.partitionBy("entity").orderBy("day_label", "row_no", "block_no")
        e = e.withColumn("x_r", F.row_number().over(w) - 1).withColumn("chunk_no", F.floor(F.col("x_r") / spec.limit).cast("int"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("x_r", "rendered"))), lambda x: x["rendered"])
    else:
        e = select_bounded(e, spec).withColumn("chunk_no", F.lit(0))
        lines = F.array_sort(F.collect_list("rendered"))
    p = e.groupBy("entity", "chunk_no").agg(F.count("*").alias("n_excerpts"), F.array_join(lines, "").alias("x_t"))
    if spec.keep_empty:
        asked = notes.filter("day is not null").filter(normalize_newlines(F.col("text")).rlike(spec.pattern)).select("entity").distinct()
        p = asked.join(p, "entity", "left").select("entity", F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), F.coalesce("n_excerpts", F.lit(0)).alias("n_excerpts"), F.coalesce("x_t", F.lit("")).alias("x_t"))
    return p.select("entity", "chunk_no", "n_excerpts", escape_newlines(F.concat("x_t", F.lit(spec.question))).alias("prompt"))


def whole_note_prompts(notes: DataFrame, suffix: str = "") -> DataFrame:
    """(row_no, prompt): the whole text with a suffix, keyed by document."""
    return notes.select("row_no", escape_newlines(F.concat(normalize_newlines(F.col("text")), F.lit(suffix))).alias("prompt"))
