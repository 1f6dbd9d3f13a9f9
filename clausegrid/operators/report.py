"""Reports: counting, ordering and gating findings, and hanging them on the changes they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import text as T

# Categories that without an action are warnings.
WARNING_CATEGORIES = ["broken_reference", "shifted_reference", "unresolvable_relative_reference", "section_removed", "section_added", "section_renamed"]
MAX_ADVISORY, MAX_FACTS = 25, 20


def counters(findings: DataFrame, keys: list[str]) -> DataFrame:
    """verified, advisory, critical, major, minor and info counts by key."""
    by = lambda column, value: F.count_if(F.col(column) == value).alias(value)
    return findings.groupBy(*keys).agg(by("class", "verified"), by("class", "advisory"), *(by("severity", s) for s in ("critical", "major", "minor", "info")))


def exit_code(critical: Column, major: Column) -> Column:
    return F.when(critical > 0, 2).when(major > 0, 1).otherwise(0)


def ordered(findings: DataFrame, keys: list[str], para: str = "para_index", ident: str = "id") -> DataFrame:
    """``findings`` with ``place``: by severity, then paragraph (none first), then id."""
    w = Window.partitionBy(*keys).orderBy(T.severity_rank(F.col("severity")), F.coalesce(para, F.lit(-1)), ident)
    return findings.withColumn("place", F.row_number().over(w))


def first_by(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def summarize(changes: DataFrame, keys: list[str]) -> DataFrame:
    by = lambda kind: F.count_if(F.col("type") == kind).alias(kind)
    return changes.groupBy(*keys).agg(by("added"), by("removed"), by("modified"), F.count("*").alias("total"))


def substantive(changes: DataFrame, keys: list[str], n: int = MAX_ADVISORY) -> DataFrame:
    """The first n changes of each key that are more than punctuation."""
    return first_by(changes.where("not cosmetic"), keys, ["change_id"], n)


def attach(findings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``findings`` (para_index, side, node_id, category, n_actions) with ``change_id``, null where they are warnings.

    Tried in order: the change that covers the paragraph on the finding's side (the last one, if
    several do), the first change at the same node, the only change in the same article.
    changes: change_id, prev_indexes, curr_indexes, node_id.
    """
    sided = lambda column, side: changes.select(*keys, "change_id", F.explode(column).alias("para_index")).groupBy(*keys, "para_index").agg(F.max("change_id").alias("by_para")).withColumn("side", F.lit(side))
    by_para = sided("curr_indexes", "curr").unionByName(sided("prev_indexes", "prev"))
    by_node = changes.where("node_id <> ''").groupBy(*keys, "node_id").agg(F.min("change_id").alias("by_node"))
    by_article = changes.withColumn("article", T.article_of(F.col("node_id"))).where("article <> ''").groupBy(*keys, "article").agg(F.count("*").alias("_n"), F.min("change_id").alias("by_article")).where("_n = 1").drop("_n")
    out = findings.withColumn("side", F.when(F.coalesce("side", F.lit("")) == "", "curr").otherwise(F.col("side"))).withColumn("article", T.article_of(F.coalesce("node_id", F.lit(""))))
    out = out.join(by_para, [*keys, "para_index", "side"], "left").join(by_node, [*keys, "node_id"], "left").join(by_article, [*keys, "article"], "left")
    warning = F.col("category").isin(WARNING_CATEGORIES) & (F.col("n_actions") == 0)
    return out.withColumn("change_id", F.when(~warning, F.coalesce("by_para", "by_node", "by_article"))).drop("by_para", "by_node", "by_article", "article")
