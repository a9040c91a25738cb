"""Serving state as relations: slots and their states, task queues, cells of a sequence memory, snapshots, partial answers.

Everything here is a DataFrame step on keyed rows; the same functions run in ``foreachBatch`` of a stream. Events of one key are
ordered by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The states of a slot in their order.
STATES = ("idle", "started", "processing_prompt", "done_prompt", "generating")


def slot_states(events: DataFrame) -> DataFrame:
    """(slot, seq, event, state): state after each event (slot, seq, event).

    launch starts a slot, prompt begins and prompt_done ends its prompt, token generates, release and cancel make it idle. An event that
    doesn't fit keeps the state; so a state depends on the events since the slot was last idle, counted by kind.
    """
    w = Window.partitionBy("slot").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumn("x_run", F.sum(F.col("event").isin("release", "cancel").cast("int")).over(past))
    run = Window.partitionBy("slot", "x_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = {}
    for need, kind in ((None, "launch"), ("launch", "prompt"), ("prompt", "prompt_done"), ("prompt_done", "token")):
        fits = F.col("event") == kind
        if need:
            fits = fits & (F.col(f"x_{need}") < F.col("seq"))
        d = d.withColumn(f"x_{kind}", F.min(F.when(fits, F.col("seq"))).over(run))
        first[kind] = F.col(f"x_{kind}")
    state = F.lit("idle")
    for kind, name in zip(("launch", "prompt", "prompt_done", "token"), STATES[1:], strict=True):
        state = F.when(first[kind].isNotNull(), name).otherwise(state)
    return d.select("slot", "seq", "event", F.when(F.col("event").isin("release", "cancel"), "idle").otherwise(state).alias("state"))


def queue_order(tasks: DataFrame) -> DataFrame:
    """(id, place): the order in which a queue serves tasks (id, seq, kind, target): cancelled ones go, urgent ones come first, latest first.

    A ``cancel`` row names its target; a ``defer`` row puts its target behind all others, as of its own seq.
    """
    gone = tasks.filter("kind = 'cancel'").select(F.col("target").alias("id")).distinct()
    late = tasks.filter("kind = 'defer'").groupBy(F.col("target").alias("id")).agg(F.max("seq").alias("x_late"))
    d = tasks.filter("kind in ('post', 'front')").join(gone, "id", "left_anti").join(late, "id", "left")
    group = F.when(F.col("x_late").isNotNull(), 2).when(F.col("kind") == "front", 0).otherwise(1)
    key = F.when(F.col("x_late").isNotNull(), F.col("x_late")).when(F.col("kind") == "front", -F.col("seq")).otherwise(F.col("seq"))
    return d.select("id", group.alias("rank_group"), key.alias("rank_key"))


def free_runs(cells: DataFrame, size: int, need: int) -> DataFrame:
    """(head, length): runs of at least ``need`` free places among ``size``, given the places taken (cell).

    Gaps lie between neighbours in the order of places; the lowest head is where a search from the start commits.
    """
    w = Window.orderBy("cell")  # the cells of one memory, ``size`` at most
    ends = cells.select(F.col("cell").cast("long").alias("cell")).distinct()
    ends = ends.union(ends.sparkSession.createDataFrame([(size,)], "cell long"))
    gap = ends.withColumn("head", F.coalesce(F.lag("cell").over(w) + 1, F.lit(0)))
    return gap.withColumn("length", F.col("cell") - F.col("head")).filter(F.col("length") >= need).select("head", "length")


def defragment(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` with cell renumbered without holes, in order; adds moved_from."""
    w = Window.partitionBy(*by).orderBy("cell")
    return cells.withColumn("moved_from", F.col("cell")).withColumn("cell", (F.row_number().over(w) - 1).cast("long"))


def recurrent_cells(updates: DataFrame) -> DataFrame:
    """(seq, pos, state): the last state of each sequence, which is all that a recurrent memory keeps."""
    return updates.groupBy("seq").agg(F.max_by(F.struct("pos", "state"), "pos").alias("x")).select("seq", "x.pos", "x.state")


def dual_memory(cells: DataFrame, window: int) -> DataFrame:
    """Adds in_window: whether a cell also lies in the sliding half of a dual memory (the last ``window`` places of its sequence)."""
    last = F.max("pos").over(Window.partitionBy("seq"))
    return cells.withColumn("in_window", F.col("pos") > last - window)


def save_state(cells: DataFrame, path: str, sequence: int | None = None) -> None:
    """Snapshot of a whole memory, or of one sequence, as a table."""
    (cells if sequence is None else cells.filter(F.col("seq") == sequence)).write.mode("overwrite").parquet(path)


def restore_state(spark: SparkSession, path: str, current: DataFrame | None = None, into: int | None = None) -> DataFrame:
    """A snapshot's cells; with ``into`` as that sequence, in place of what ``current`` has of it."""
    saved = spark.read.parquet(path)
    if into is None:
        return saved
    saved = saved.withColumn("seq", F.lit(into).cast(dict(saved.dtypes)["seq"]))
    return saved if current is None else current.filter(F.col("seq") != into).unionByName(saved)


def reuse_prefix(requests: DataFrame, system: Column) -> DataFrame:
    """Adds shared (characters of a request's prompt that the system prompt has evaluated already) and rest."""
    hit = F.startswith(F.col("prompt"), system)
    shared = F.when(hit, F.length(system)).otherwise(0)
    return requests.withColumn("shared", shared).withColumn("rest", F.substring(F.col("prompt"), F.col("shared") + 1, F.length("prompt")))


def terminated(tokens: DataFrame, ends: list[int], n_predict: int) -> DataFrame:
    """The tokens (key, pos, id) of each key before its first end-of-generation token, ``n_predict`` at most (none set: -1)."""
    w = Window.partitionBy("key").orderBy("pos")
    d = tokens.withColumn("x_n", F.row_number().over(w)).withColumn("x_end", F.max(F.col("id").isin(ends).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter((F.col("x_end") == 0) & (F.lit(n_predict < 0) | (F.col("x_n") <= n_predict))).drop("x_n", "x_end")


def response_diffs(updates: DataFrame) -> DataFrame:
    """(key, seq, delta): what each partial answer (key, seq, content) adds to the one before; a text that was changed comes whole."""
    before = F.coalesce(F.lag("content").over(Window.partitionBy("key").orderBy("seq")), F.lit(""))
    grown = F.startswith(F.col("content"), before)
    delta = F.when(grown, F.substring(F.col("content"), F.length(before) + 1, F.length("content"))).otherwise(F.col("content"))
    return updates.select("key", "seq", delta.alias("delta")).filter("delta <> ''")


def event_stream(deltas: DataFrame) -> DataFrame:
    """(key, seq, line): server-sent events of the deltas, in JSON."""
    body = F.to_json(F.struct(F.col("delta").alias("content")))
    return deltas.select("key", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("line"))


def lookahead_pool(tokens: DataFrame, n: int, most: int) -> DataFrame:
    """(first, ngram, slot): of each first token the last ``most`` different n-grams seen, in a ring: (key, pos, id) rows in order of (key, pos)."""
    w = Window.partitionBy("key").orderBy("pos")
    rest = F.array(*[F.lead("id", k).over(w) for k in range(1, n)])
    d = tokens.withColumn("ngram", rest).filter(~F.exists("ngram", lambda x: x.isNull()))
    seen = d.groupBy(F.col("id").alias("first"), "ngram").agg(F.max(F.struct("key", "pos")).alias("at"))
    r = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("at")))
    return seen.withColumn("slot", r - 1).filter(F.col("slot") < most).select("first", "ngram", "slot")


def speculate(target: DataFrame, draft: DataFrame) -> DataFrame:
    """(key, accepted, next_id): length of a draft (key, pos, id) that equals the target model's choices, and the target's own token behind it."""
    j = target.join(draft.withColumnRenamed("id", "d_id"), ["key", "pos"], "left")
    g = j.groupBy("key").agg(F.min(F.when(~F.col("id").eqNullSafe(F.col("d_id")), F.struct("pos", "id"))).alias("x"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    accepted = F.coalesce(F.col("x.pos"), F.col("hi") + 1) - F.col("lo")
    return g.select("key", accepted.alias("accepted"), F.col("x.id").alias("next_id"))


def speculate_lists(target: Column, draft: Column) -> Column:
    """(accepted, next_id) as ``speculate`` has them, of a draft and the target's choices that stand in one row as lists: nothing is shuffled."""
    draft = F.coalesce(draft, F.slice(target, 1, 0))
    missed = F.array_position(F.zip_with(target, draft, lambda t, d: t.eqNullSafe(d)), F.lit(False))
    # no miss (0) becomes the largest number: the lists are compared in one place of the expression only
    accepted = F.least((missed - 1).bitwiseAND(F.lit(2**31 - 1)), F.size(target).cast("long"))
    return F.get(F.transform(F.array(accepted), lambda n: F.struct(n.alias("accepted"), F.get(target, n.cast("int")).alias("next_id"))), F.lit(0))
