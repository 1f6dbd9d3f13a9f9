"""Model usage: sums by node with a grand total, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default rates by tier, US dollars for a million tokens in and out, and what cached input costs of the input rate.
RATES = {"triage": (1.0, 5.0), "analyze": (3.0, 15.0), "recommend": (5.0, 25.0), "adjudicate": (5.0, 25.0)}
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def rates(spark, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(tier, rate_in, rate_out, rate_read, rate_write): defaults under overrides."""
    rows = [(k, float(i), float(o), i * CACHE_READ, i * CACHE_WRITE) for k, (i, o) in (RATES | (overrides or {})).items()]
    return spark.createDataFrame(rows, "tier string, rate_in double, rate_out double, rate_read double, rate_write double")


def uncached(total: Column, read: Column, write: Column) -> Column:
    """Input tokens that no cache served; all of them if the parts do not add up."""
    return F.when(total - read - write < 0, total).otherwise(total - read - write)


def cost(fresh: Column, read: Column, write: Column, out: Column) -> Column:
    million = F.lit(1e6)
    return fresh / million * F.col("rate_in") + read / million * F.col("rate_read") + write / million * F.col("rate_write") + out / million * F.col("rate_out")


def rollup(calls: DataFrame, measures: list[str]) -> DataFrame:
    """(node, calls, measures): sums for each node, and for all of them under ``total``."""
    summed = calls.rollup("node").agg(F.grouping("node").alias("_all"), F.count("*").alias("calls"), *(F.sum(m).alias(m) for m in measures))
    return summed.withColumn("node", F.when(F.col("_all") == 1, "total").otherwise(F.col("node"))).drop("_all")
