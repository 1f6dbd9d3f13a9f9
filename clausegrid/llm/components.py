"""Connected components of a link table, without collecting it: alternating large and small stars.

Each task first reduces its links to forests of stars, so the rounds that follow see few links; up
to ``SMALL`` of them, a fixed bound, are finished in one task without rounds.
Every round is written to the shared checkpoint folder. A node of any degree is handled by minima
and joins, never by a list of its neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that one task holds at a time.
HELD = 200_000
SMALL = 300_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node) with the same components as the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    return np.array(nodes, np.int64), np.array([root(x) for x in nodes], np.int64)


def _stars(held: int):
    """Mapper: links as forests of at least ``held`` links each, but the last."""

    def mapped(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size >= held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*kept)))], ["a", "b"])
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*kept)))], ["a", "b"])

    return mapped


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component): the least node of each linked node's component; nodes that are the least are left out.

    links: columns a and b (bigint). Self links and repeated links do no harm; no links give no rows.
    """
    edges = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    edges = common.checkpoint(edges.mapInArrow(_stars(HELD), "a bigint, b bigint").distinct())
    if edges.count() <= small:
        whole = edges.coalesce(1).mapInArrow(_stars(small + 1), "a bigint, b bigint")  # ``small`` rows at most
        return common.checkpoint(whole).select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = common.checkpoint(small.distinct())
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        inner = edges.select(F.col("b").alias("a")).join(edges.select("a"), "a", "left_semi")
        if twice.unionByName(inner).isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
