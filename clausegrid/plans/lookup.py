"""Read-only lookups over a comparison's tables, as a model's tools would ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import references as R
from clausegrid.functions import text as T
from clausegrid.operators import integrity, tree

KEYS = ["pair_id"]
MAX_RADIUS, DEPTH = 5, 2
# Characters of a resolved target's and of a citing paragraph's text.
TARGET_CLIP, CITING_CLIP = 600, 300


def paragraph(paragraphs: DataFrame, nodes: DataFrame, index: int, radius: int = 0) -> DataFrame:
    """The paragraphs within ``radius`` (0 to 5) of one, each with the node it belongs to."""
    radius = max(0, min(MAX_RADIUS, radius))
    near = paragraphs.where(F.col("idx").between(index - radius, index + radius))
    own = tree.owners(paragraphs, nodes, KEYS).select(*KEYS, "idx", "node_id", "path")
    return near.select(*KEYS, "idx", "text").join(own, [*KEYS, "idx"], "left").orderBy(*KEYS, "idx")


def section_tree(nodes: DataFrame, root_id: str = "root", depth: int = DEPTH) -> DataFrame:
    """A node's descendants down to ``depth``, in the order of the document, with their depth below it."""
    level = nodes.where(F.col("node_id") == root_id).select(*KEYS, "node_id", F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        below = level.select(*KEYS, F.col("node_id").alias("parent_id"))
        level = nodes.join(below, [*KEYS, "parent_id"]).select(*KEYS, "node_id", F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return nodes.join(out, [*KEYS, "node_id"]).select(*KEYS, "node_id", "depth", "preorder", "kind", "number", "title", "start", "end").orderBy(*KEYS, "preorder")


def descendants(nodes: DataFrame, node_id: str) -> DataFrame:
    """All nodes below one: those that come after it and begin within its range, on deeper levels."""
    top = nodes.where(F.col("node_id") == node_id).select(*KEYS, F.col("preorder").alias("_at"), F.col("end").alias("_end"), F.col("level").alias("_level"))
    found = nodes.join(top, KEYS).where("preorder > _at and head_index <= _end and level > _level")
    return found.drop("_at", "_end", "_level").orderBy(*KEYS, "preorder")


def siblings(nodes: DataFrame, node_id: str) -> DataFrame:
    """The nodes of a node's kind under its parent, itself included, in the order of the document."""
    own = nodes.where(F.col("node_id") == node_id).select(*KEYS, "parent_id", "kind")
    return nodes.join(own, [*KEYS, "parent_id", "kind"]).orderBy(*KEYS, "preorder")


def resolve_reference(paragraphs: DataFrame, nodes: DataFrame, citation: str) -> DataFrame:
    """Each pair's answer to a citation: whether its target is there, the deepest node on the way, and the text of that."""
    found = R.extract(citation)
    r = found[0] if found else {"lang": "id", "pasal": "", "ayat": "", "huruf": "", "angka": ""}
    spark = nodes.sparkSession
    row = [(r["lang"], r["pasal"], r["ayat"], r["huruf"], r["angka"])]
    asked = nodes.select(*KEYS).distinct().crossJoin(F.broadcast(spark.createDataFrame(row, "lang string, pasal string, ayat string, huruf string, angka string")))  # one row
    asked = asked.withColumn("target_id", R.target_id(*(F.col(c) for c in ("lang", "pasal", "ayat", "huruf", "angka"))))
    done = integrity.resolve(asked, nodes, KEYS, "found")
    steps = [f"pasal:{r['pasal']}", f"article:{r['pasal']}"]
    paths = list(steps)
    tail = ""
    for part in ("ayat", "huruf", "angka"):
        if r[part]:
            tail += f"/{part}:{r[part]}"
            paths += [s + tail for s in steps]
    deepest = nodes.where(F.col("node_id").isin(paths)).groupBy(*KEYS).agg(F.max_by("node_id", F.struct(F.length("node_id"), "node_id")).alias("node_id"))
    texts = integrity.node_text(nodes.join(deepest, [*KEYS, "node_id"], "left_semi"), paragraphs, KEYS)
    out = done.select(*KEYS, "target_id", "found").join(deepest, KEYS, "left").join(texts, [*KEYS, "node_id"], "left")
    return out.select(*KEYS, "target_id", "found", "node_id", T.clip(F.col("node_text"), TARGET_CLIP).alias("text"))


def references_to(paragraphs: DataFrame, refs: DataFrame, node_id: str) -> DataFrame:
    """The paragraphs that cite a node, in order."""
    citing = refs.where(F.col("target_id") == node_id).select(*KEYS, F.col("para_index").alias("idx"), "ref_seq", "raw")
    return citing.join(paragraphs.select(*KEYS, "idx", "text"), [*KEYS, "idx"]).select(*KEYS, "idx", "ref_seq", "raw", T.clip(F.col("text"), CITING_CLIP).alias("text")).orderBy(*KEYS, "idx", "ref_seq")


def compared_paragraph(changes: DataFrame, index: int) -> DataFrame:
    """The changes that touch a paragraph of the new version."""
    return changes.where(F.array_contains("curr_indexes", index))
