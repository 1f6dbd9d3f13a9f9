"""Runs of headings that should keep step, such as the same clauses in two languages.

A table of headings has key columns (the document), ``keyword``, ``pos`` and ``ordinal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_RUN, MIN_ALTERNATION = 3, 0.6
CATEGORY = "parallel_mismatch"


def runs(headings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, keyword, run_len, first_pos, run): runs of a document, numbered by where they begin."""
    found = headings.groupBy(*keys, "keyword").agg(F.count("*").alias("run_len"), F.min("pos").alias("first_pos"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos", "keyword")))


def parallel_runs(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Members of long runs of documents whose runs alternate; adds run, run_len, place (from 1), shortest, base (the first run's ordinal there) and, where headings have them, its base_pos, base_keyword, base_number and base_label."""
    long = runs(headings, keys).where(F.col("run_len") >= MIN_RUN)
    whole = Window.partitionBy(*keys)
    long = long.withColumn("run", F.row_number().over(whole.orderBy("first_pos", "keyword")))
    members = headings.join(long.select(*keys, "keyword", "run", "run_len"), [*keys, "keyword"])
    order = whole.orderBy("pos")
    members = members.withColumns({"ahead": F.lag("keyword").over(order), "n": F.count("*").over(whole), "n_runs": F.max("run").over(whole), "shortest": F.min("run_len").over(whole)})
    members = members.withColumn("switches", F.sum(F.coalesce((F.col("ahead") != F.col("keyword")).cast("int"), F.lit(0))).over(whole))
    kept = members.where((F.col("n_runs") >= 2) & (F.col("n") >= 2 * MIN_RUN) & (F.col("switches") >= MIN_ALTERNATION * (F.col("n") - 1)))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "keyword").orderBy("pos")))
    first = lambda c: F.max(F.when(F.col("run") == 1, F.col(c))).over(Window.partitionBy(*keys, "place"))
    named = {f"base_{c}": first(c) for c in ("pos", "keyword", "number", "label") if c in headings.columns}
    return kept.withColumns({"base": first("ordinal"), **named}).drop("ahead")


def mismatches(headings: DataFrame, keys: list[str]) -> DataFrame:
    """Members beyond the shortest run (``problem`` count), and those that differ from the first run's at their place (position)."""
    p = parallel_runs(headings, keys)
    beyond = F.col("place") > F.col("shortest")
    differs = ~beyond & (F.col("run") > 1) & (F.col("ordinal") != F.col("base"))
    return p.where(beyond | differs).withColumns({"problem": F.when(beyond, "count").otherwise("position"), "category": F.lit(CATEGORY), "severity": F.lit("major")})


def describe(headings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts, counted): how many headings each parallel run has, in run order, as text and as a list."""
    p = parallel_runs(headings, keys).groupBy(*keys, "run", "keyword").agg(F.count("*").alias("n"))
    p = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "keyword", F.col("n").cast("string").alias("n")))).alias("_runs"))
    said = lambda between, after: F.transform("_runs", lambda x: F.concat(F.lit('"'), x["keyword"], F.lit(between), x["n"], F.lit(after)))
    return p.select(*keys, F.array_join(said('" punya ', ""), " dan ").alias("counts"), said('": ', " judul").alias("counted"))
