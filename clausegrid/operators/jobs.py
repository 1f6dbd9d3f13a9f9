"""Jobs, their steps and their trace, as tables: latest wins, except where the first does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of a job in order, and those a job without a model skips.
STEPS = ["ingest_prev", "ingest_curr", "deterministic", "triage", "analyze", "recommend", "assemble"]
PAID = ["triage", "analyze", "recommend"]
#: Waiting jobs beyond which new ones are turned away.
QUEUE = 64


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert by key: the row with the greatest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_trace(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert of trace entries: text is the latest, node, kind and time stay as first written."""
    return rows.groupBy(*keys).agg(F.max_by("text", version).alias("text"), *(F.min_by(c, version).alias(c) for c in ("node", "kind", "at")))


def coalesce_stream(events: DataFrame, job: str, order: str) -> DataFrame:
    """(job, seq, node, kind, text, chunks): pieces that one node streams in a row, as one entry.

    A piece goes on the entry before it if node and kind are the same; notes always stand alone.
    """
    w = Window.partitionBy(job).orderBy(order)
    same = (F.lag("node").over(w) == F.col("node")) & (F.lag("kind").over(w) == F.col("kind")) & (F.col("kind") != "note")
    marked = events.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    numbered = marked.withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return numbered.groupBy(job, "seq", "node", "kind").agg(text.alias("text"), F.count("*").alias("chunks"))


def initial_steps(jobs: DataFrame) -> DataFrame:
    """(job_id, place, node, status): every job's steps, the paid ones skipped without a model."""
    places = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("node")) for k, n in enumerate(STEPS)))
    out = jobs.select("job_id", "use_ai", F.explode(places).alias("x")).select("job_id", "use_ai", "x.*")
    return out.select("job_id", "place", "node", F.when(~F.col("use_ai") & F.col("node").isin(PAID), "skipped").otherwise("pending").alias("status"))


def progress(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, status): the last that was heard of each step."""
    status = F.when(F.col("event") == "start", "running").when(F.col("event") == "done", "done").when(F.col("event") == "error", "error")
    return events.withColumn("status", status).where("status is not null").groupBy(*keys).agg(F.max_by("status", order).alias("status"))


def finish_steps(job_status: Column, step_status: Column) -> Column:
    """What a step is once its job is over: open ones are skipped if it was done, errors if it failed."""
    open_one = step_status.isin("pending", "running")
    return F.when(open_one & (job_status == "done"), "skipped").when(open_one & (job_status == "failed"), "error").otherwise(step_status)


def restore(status: Column) -> Column:
    """A job's status after a restart: what was under way has failed."""
    return F.when(status.isin("queued", "running"), "failed").otherwise(status)


def admitted(waiting: DataFrame, order: list, queue: int = QUEUE) -> DataFrame:
    """Waiting jobs with ``admitted``: the first ones up to the queue's length."""
    first = waiting.orderBy(*order).limit(queue).select("job_id").withColumn("admitted", F.lit(True))
    return waiting.join(F.broadcast(first), "job_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def trace_by_node(trace: DataFrame) -> DataFrame:
    """(job_id, place, node, entries, texts): each job's trace by step in pipeline order; steps without entries are left out."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("node")) - 1
    rows = trace.withColumn("place", place).where("place >= 0")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("job_id", "place", "node").agg(F.count("*").alias("entries"), texts.alias("texts"))
