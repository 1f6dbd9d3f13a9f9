"""Job progress as a stream: every batch's latest step states are merged into a table of states.

Events are upserted by (job, step), so a batch that is run again changes nothing; a reader who comes
late reads the table, then follows the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import jobs

from .sinks import settle

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_progress(stream: DataFrame) -> DataFrame:
    """(job_id, node, event, event_id) of raw events: what a step reports."""
    steps = F.array(*map(F.lit, jobs.STEPS))
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    return stream.select(F.col("user_id").alias("job_id"), F.get(steps, (F.col("event_id") % len(jobs.STEPS)).cast("int")).alias("node"), event.alias("event"), "event_id").where("event is not null")


def states(stream: DataFrame) -> DataFrame:
    """(job_id, node, status, event_id): the streaming aggregate behind the table, to be written in update or complete mode."""
    status = F.when(F.col("event") == "start", "running").otherwise(F.col("event"))
    latest = F.max(F.struct("event_id", status.alias("status")))
    return as_progress(stream).groupBy("job_id", "node").agg(latest.alias("x")).select("job_id", "node", "x.status", "x.event_id")


def inbox(spark: SparkSession, path: str, max_bytes: int = 32 << 20) -> DataFrame:
    """Uploaded files as a stream: (pair_id, side, path, content, error) of <inbox>/<pair>/<side>.<suffix>; an oversized one has an error and no content."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    pair, side = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"(prev|curr)\.[^./]*$", 1)
    fits = F.col("length") <= max_bytes
    error = F.when(~fits, F.lit(f"larger than {max_bytes} bytes"))
    return files.where(side != "").select(pair.alias("pair_id"), side.alias("side"), "path", F.when(fits, F.col("content")).alias("content"), error.alias("error"))


def run_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states after all event files there are now: of each step's updates the last."""
    updates = settle(states(events(spark, f"{sf_dir}/events.parquet*")), "update")
    return updates.groupBy("job_id", "node").agg(F.max_by("status", "event_id").alias("status"))
