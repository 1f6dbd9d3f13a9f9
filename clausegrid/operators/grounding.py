"""Grounding: a proposed edit counts only if the text it would change is really there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import text as T

# Fixed value: what a finding says whose edits were all rejected.
REJECTED = " (usulan perbaikan otomatis ditolak validator; perlu tinjauan manual)"


def rejection(kind: Column, index: Column, n_paragraphs: Column, text: Column, old: Column, new: Column) -> Column:
    """The first rule that an action breaks, null if it holds: out_of_range, no_index, empty_old, not_found, no_change."""
    inside = index.isNotNull() & (index >= 0) & (index < n_paragraphs)
    found = (F.instr(text, old) > 0) | (T.normalize_aggressive(old) == "") | (F.instr(T.normalize_aggressive(text), T.normalize_aggressive(old)) > 0)
    return (
        F.when(kind == "manual_review", F.when(index.isNotNull() & ~inside, "out_of_range"))
        .when(index.isNull(), "no_index")
        .when(~inside, "out_of_range")
        .when(F.trim(F.coalesce(old, F.lit(""))) == "", "empty_old")
        .when(~F.coalesce(found, F.lit(False)), "not_found")
        .when(old == new, "no_change")
    )


def ground_actions(actions: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """``actions`` (keys, type, paragraph_index, old, new) with ``reason``, null where accepted."""
    sizes = paragraphs.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    texts = paragraphs.select(*keys, F.col("idx").alias("paragraph_index"), F.col("text").alias("_text"))
    joined = actions.join(sizes, keys, "left").join(texts, [*keys, "paragraph_index"], "left")
    reason = rejection(F.col("type"), F.col("paragraph_index"), F.coalesce("_n", F.lit(0)), F.col("_text"), F.col("old"), F.col("new"))
    return joined.withColumn("reason", reason).drop("_n", "_text")


def ground_findings(findings: DataFrame, grounded: DataFrame, keys: list[str]) -> DataFrame:
    """``findings`` with counts of accepted and rejected actions; one with none left loses half its confidence, and its message says so."""
    per = grounded.groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    out = findings.join(per, keys, "left").withColumns({"accepted": F.coalesce("accepted", F.lit(0).cast("long")), "rejected": F.coalesce("rejected", F.lit(0).cast("long"))})
    lost = (F.col("accepted") == 0) & (F.col("rejected") > 0)
    said = {"message": F.concat("message", F.when(lost, REJECTED).otherwise(""))} if "message" in findings.columns else {}
    return out.withColumns({"confidence": F.when(lost, F.col("confidence") * 0.5).otherwise(F.col("confidence")), **said})


def feedback(grounded: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, feedback): rejected actions as ``#i: reason`` lines."""
    rows = grounded.where("reason is not null")
    line = F.concat(F.lit("#"), F.col(order).cast("string"), F.lit(": "), F.col("reason"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("feedback"))
