"""Writers: a report as JSON or text, and a tree as indented lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import text as T

EVIDENCE_CLIP, CHANGE_CLIP = 110, 140
# How severities and edits are called in a text report.
SEVERITY_LABELS = {"critical": "KRITIS", "major": "MAYOR", "minor": "MINOR", "info": "INFO"}


def json_lines(rows: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """(keys, json): each row's other columns as one JSON object."""
    return rows.select(*keys, F.to_json(F.struct(*(c for c in rows.columns if c not in keys))).alias(name))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def finding_lines(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, line): findings in report order as lines of text, each with a line for every piece of its evidence."""
    labels = F.create_map(*(F.lit(x) for pair in SEVERITY_LABELS.items() for x in pair))
    where = F.when(F.col("para_index").isNotNull(), F.concat(F.lit(" ["), F.col("para_index").cast("string"), F.lit("]"))).otherwise("")
    head = F.concat(F.lit("["), F.try_element_at(labels, F.col("severity")), F.lit("]"), where, F.lit(" "), F.col("message"))
    proof = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.concat(F.lit("\n    bukti: "), T.clip(e, EVIDENCE_CLIP, "...")))
    return findings.select(*keys, "place", F.concat(head, F.array_join(proof, "")).alias("line"))


def change_lines(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change_id, line): changes as lines of text."""
    line = F.concat(F.lit("#"), F.col("change_id").cast("string"), F.lit(" "), F.col("type"), F.lit(": "), T.clip(F.col("prev_text"), CHANGE_CLIP, "..."), F.lit(" => "), T.clip(F.col("curr_text"), CHANGE_CLIP, "..."))
    return changes.select(*keys, "change_id", line.alias("line"))


def tree_lines(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, preorder, line): the tree, each node indented by its level."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" — "), F.col("title"))).otherwise("")
    depth = F.greatest(F.col("level") - 1, F.lit(0))
    return nodes.where("kind <> 'root'").select(*keys, "preorder", F.concat(F.repeat(F.lit("  "), depth), F.col("kind"), F.lit(" "), F.col("number"), title, F.lit(" ["), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("]")).alias("line"))
