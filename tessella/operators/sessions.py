"""Conversations, tool calls and build jobs, as batch folds of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The progress that a document has at least after a stage.
STAGE_PROGRESS = {
    "load_doc_completed": 20, "build_doc_started": 35, "build_doc_completed": 70, "index_started": 85, "index_completed": 95,
    "persist_started": 97, "persist_completed": 99, "load_doc_skipped": 100, "build_doc_failed": 100, "build_doc_skipped": 100,
}


def last_turns(conversations: DataFrame, rounds: int) -> DataFrame:
    """The last 2 * rounds messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return conversations.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * rounds).drop("_n")


def last_answer(conversations: DataFrame) -> DataFrame:
    """(conv_id, answer, n_messages): the last answer with some text."""
    said = F.when((F.col("role") == "assistant") & F.col("text").rlike(r"\S"), F.col("turn"))
    return conversations.groupBy("conv_id").agg(F.max_by("text", said).alias("answer"), F.max(said).alias("at"), F.count("*").alias("n_messages")).select(
        "conv_id", F.when(F.col("at").isNotNull(), F.col("answer")).alias("answer"), "n_messages"
    )


def within_running_budget(conversations: DataFrame, most: int) -> DataFrame:
    """Messages until the conversation's words exceed a budget."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return conversations.withColumn("words", words).withColumn("running", F.sum("words").over(w)).where(F.col("running") <= most)


def usage_counts(calls: DataFrame) -> DataFrame:
    """(session, tool, calls) of completed calls."""
    return calls.where("ended").groupBy("session", "tool").agg(F.count("*").alias("calls"))


def nth_call(calls: DataFrame, n: int) -> DataFrame:
    """The n-th oldest completed call of each session, or for n < 0 the |n|-th newest."""
    if n == 0:
        raise ValueError("calls count from 1")
    order = F.col("ord").asc() if n > 0 else F.col("ord").desc()
    w = Window.partitionBy("session").orderBy(order)
    return calls.where("ended").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == abs(n)).drop("_n")


def in_scope(calls: DataFrame, ancestor: str) -> DataFrame:
    """Calls made in a scope or below it; an empty scope holds none."""
    if not ancestor:
        return calls.limit(0)
    return calls.where((F.col("scope") == ancestor) | F.col("scope").startswith(ancestor + ">"))


def job_progress(events: DataFrame) -> DataFrame:
    """(job, progress, failed) of stage events (job, doc, stage): progress never falls, and the mean is rounded half to even.

    Stages without a document count for all documents of the job.
    """
    level = F.create_map(*[F.lit(x) for pair in STAGE_PROGRESS.items() for x in pair])
    e = events.withColumn("level", F.coalesce(F.try_element_at(level, "stage"), F.lit(0)))
    common = e.where("doc is null").groupBy("job").agg(F.max("level").alias("common"))
    docs = e.where("doc is not null").groupBy("job", "doc").agg(F.max("level").alias("own"), F.max((F.col("stage") == "build_doc_failed").cast("int")).alias("failed"))
    both = docs.join(common, "job", "left").withColumn("p", F.greatest("own", F.coalesce("common", F.lit(0))))
    return both.groupBy("job").agg(F.bround(F.avg("p")).cast("int").alias("progress"), F.sum("failed").alias("failed"))


#: Stages that end a job, and how much of an output is kept.
TERMINAL = ("job_completed", "job_failed", "job_cancelled")
OUTPUT_CHARS = 200_000


def token_usage(messages: DataFrame) -> DataFrame:
    """(conv_id, tokens, answer) of messages (conv_id, turn, role, text, total_tokens): the tokens' sum and the last answer with some text."""
    tokens = messages.groupBy("conv_id").agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))
    return tokens.join(last_answer(messages), "conv_id").select("conv_id", "tokens", "answer")


def call_log(events: DataFrame) -> DataFrame:
    """(session, call_id, nth, tool, input, output, started, ended) of start and end events in their order.

    events: session, ord, kind (start or end), call_id, tool, text. An end closes the latest open record of
    its call_id, so with nested starts of one identifier the ends match like brackets: at a start the
    depth grows, at an end it falls, and an end belongs to the last start of its depth. Ends without an
    open record close nothing.
    """
    w = Window.partitionBy("session", "call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    run = F.sum(step).over(w)
    # an end beyond the open records would take the depth below its floor so far: it is left out of the depth
    floor = F.least(F.min("run").over(w), F.lit(0))
    e = events.withColumn("run", run).withColumn("floor", floor)
    before = F.coalesce(F.lag("floor").over(Window.partitionBy("session", "call_id").orderBy("ord")), F.lit(0))
    e = e.withColumns({"lost": (F.col("kind") == "end") & (F.col("floor") < before)})
    e = e.withColumn("depth", F.col("run") - F.col("floor") + F.when((F.col("kind") == "end") & ~F.col("lost"), 1).otherwise(0)).where("not lost")
    level = Window.partitionBy("session", "call_id", "depth").orderBy("ord")
    e = e.withColumns({"next_kind": F.lead("kind").over(level), "end_ord": F.lead("ord").over(level), "end_text": F.lead("text").over(level)})
    closed = F.col("next_kind") == "end"
    starts = e.where("kind = 'start'").select(
        "session", "call_id", "tool", F.col("text").alias("input"), F.col("ord").alias("started"),
        F.when(closed, F.col("end_ord")).alias("ended"), F.when(closed, F.substring(F.coalesce("end_text", F.lit("")), 1, OUTPUT_CHARS)).alias("output"),
    )
    nth = F.row_number().over(Window.partitionBy("session").orderBy("started"))
    return starts.withColumn("nth", nth).select("session", "call_id", "nth", "tool", "input", "output", "started", "ended")


def job_states(events: DataFrame) -> DataFrame:
    """(job, state, progress, failed) of stage events (job, ord, doc, stage): the first terminal stage ends a job, and what follows changes nothing.

    A job without one is running, and its progress is that of `job_progress`; a completed one has 100.
    """
    first = events.where(F.col("stage").isin(*TERMINAL)).groupBy("job").agg(F.min(F.struct("ord", "stage")).alias("t"))
    live = events.join(first, "job", "left").where(F.col("t").isNull() | (F.col("ord") < F.col("t.ord"))).select("job", "doc", "stage")
    jobs = events.select("job").distinct().join(first, "job", "left").join(job_progress(live.where(~F.col("stage").isin(*TERMINAL))), "job", "left")
    state = F.coalesce(F.regexp_replace("t.stage", "^job_", ""), F.lit("running"))
    progress = F.when(F.col("t.stage") == "job_completed", F.lit(100)).otherwise(F.coalesce("progress", F.lit(0)))
    return jobs.select("job", state.alias("state"), progress.cast("int").alias("progress"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))
