"""Trace entries as a stream: pieces extend the open entry of their node, and each extension is emitted whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import events
from .sinks import settle

ENTRY = "job_id bigint, seq bigint, node string, kind string, text string, version bigint"
STATE = "seq bigint, node string, kind string, text string"


def extend(state: tuple | None, pieces: list[tuple[int, str, str, str]]):
    """Entries (seq, node, kind, text, version) that pieces (order, node, kind, text) change, and the new state.

    A piece goes on the open entry if node and kind are the same; a note closes it and stands alone.
    """
    seq, node, kind, text = state or (0, None, None, "")
    out: dict[int, tuple] = {}
    for order, n, k, t in sorted(pieces):
        if k != "note" and (n, k) == (node, kind):
            text += t
        else:
            seq, node, kind, text = seq + 1, n, k, t
        out[seq] = (seq, n, k, text, order)
    return list(out.values()), (seq, node, kind, text)


def entries(stream: DataFrame) -> DataFrame:
    """(job_id, seq, node, kind, text, version) of a stream of (job_id, order, node, kind, text); the greatest version of an entry is its last state."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pieces = [p for f in frames for p in zip(f["order"].tolist(), f["node"], f["kind"], f["text"])]
        out, new = extend(state.get if state.exists else None, pieces)
        state.update(new)
        yield pd.DataFrame([(key[0], *e) for e in out], columns=["job_id", "seq", "node", "kind", "text", "version"])

    return stream.groupBy("job_id").applyInPandasWithState(update, ENTRY, STATE, "append", GroupStateTimeout.NoTimeout)


def run_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after all event files there are now, each as it last stood."""
    e = events(spark, f"{sf_dir}/events.parquet*")
    kind = F.when(F.col("event_type") == "error", "note").when(F.col("event_type") == "view", "thought").otherwise("tool_call")
    node = F.when(F.col("event_type").isin("view", "click"), "triage").otherwise("analyze")
    pieces = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("order"), node.alias("node"), kind.alias("kind"), F.col("event_type").alias("text"))
    return settle(entries(pieces), "append").groupBy("job_id", "seq").agg(F.max_by(F.struct("node", "kind", "text"), "version").alias("x")).select("job_id", F.col("seq").cast("long").alias("seq"), "x.*")
