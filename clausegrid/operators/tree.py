"""From paragraphs to a tree of headings and list markers, one document at a time.

What a paragraph says about itself (a heading, a marker) is read by JVM expressions over the whole
table. Only the nesting, which depends on all that is still open, runs per document in Python; the
documents of a table are spread over its tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import headings as H
from clausegrid.functions import markers as M
from clausegrid.functions import references as R
from clausegrid.functions import text as T

ARTICLES = ("pasal", "article")
CAPTIONED = ("bab", "bagian", "paragraf")
ALPHA = ("LOWER", "UPPER")

NODE_FIELDS = "node_id string, parent_id string, preorder int, kind string, label string, number string, ordinal int, marker_kind string, marker_form string, marker_raw string, level int, head_index int, start int, end int, title string, path string, full_path string, article_id string, article_number string, article_kind string"
REF_FIELDS = "para_index int, ref_seq int, raw string, start int, end int, kind string, pasal string, ayat string, huruf string, angka string, lang string"


@dataclass
class Node:
    kind: str
    number: str = ""
    ordinal: int = 0
    label: str = ""
    head: int = -1
    level: int = 0
    marker: dict | None = None
    title: str = ""
    end: int = -1
    ident: str = "root"
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)

    def cited(self) -> str:
        names = {"pasal": "Pasal {}", "article": "Article {}", "bab": "BAB {}", "bagian": "Bagian {}", "paragraf": "Paragraf {}", "ayat": "ayat ({})", "huruf": "huruf {}", "angka": "angka {}", "clause": "{}"}
        return names[self.kind].format(self.number) if self.kind in names else self.label or self.number

    def article(self) -> Node | None:
        node: Node | None = self
        while node and node.kind not in ARTICLES:
            node = node.parent
        return node

    def path(self) -> str:
        """The citation of a node, from its article down."""
        above = "" if self.kind in ("root", *ARTICLES) else self.parent.path()
        return f"{above} {self.cited()}".strip() if self.kind != "root" else ""

    def full_path(self) -> str:
        """The citation of a node with all that it lies in."""
        return f"{self.parent.full_path()} {self.cited()}".strip() if self.kind != "root" else ""


def one_family(a: dict, b: dict) -> bool:
    """Whether two markers may belong to one list; a reading that is still open does not part them."""
    if a["form"] != b["form"]:
        return False
    return a["kind"] == b["kind"] or (a["ambiguous"] and a["alt_kind"] == b["kind"]) or (b["ambiguous"] and b["alt_kind"] == a["kind"])


def named(kind: str, form: str) -> str:
    if kind == "DECIMAL":
        return "clause"
    if kind in ALPHA:
        return "huruf"
    if kind in ("L_ROM", "U_ROM"):
        return "item"
    return "ayat" if form == "BRACKET" else "angka"


def settle(markers: list[dict]) -> None:
    """Give all open readings of one list the family that the list agrees on."""
    counted = lambda key: sum(1 for _ in _counting(m[key] for m in markers))
    sure = next((m["kind"] for m in markers if not m["ambiguous"]), None)
    if sure is None:
        sure = markers[0]["alt_kind"] if counted("alt_ordinal") > counted("ordinal") else markers[0]["kind"]
    for m in markers:
        if m["ambiguous"]:
            if (sure in ALPHA) != (m["kind"] in ALPHA):
                m["kind"], m["alt_kind"] = m["alt_kind"], m["kind"]
                m["ordinal"], m["alt_ordinal"] = m["alt_ordinal"], m["ordinal"]
            m["ambiguous"] = False


def _counting(values):
    want = 1
    for v in values:
        if v == want:
            want += 1
            yield v


def grow(paragraphs: list[dict]) -> Node:
    """The tree of one document. A paragraph has idx, text, heading (or None), marker (or None) and is_caption."""
    root = Node("root")
    open_nodes = [root]

    def attach(node: Node, level: int) -> None:
        node.level = level
        while len(open_nodes) > 1 and open_nodes[-1].level >= level:
            open_nodes.pop().end = node.head - 1
        node.parent = open_nodes[-1]
        node.parent.children.append(node)
        open_nodes.append(node)

    last = -1
    for p in paragraphs:
        last = p["idx"]
        if not p["text"]:
            continue
        if p["heading"]:
            h = p["heading"]
            attach(Node(h["kind"], h["number"], h["ordinal"], h["label"], p["idx"]), H.DEPTHS[h["kind"]])
            continue
        m = p["marker"]
        if m:
            sibling = next((n for n in reversed(open_nodes[1:]) if n.marker and one_family(n.marker, m)), None)
            opens = m["ordinal"] <= M.HIGHEST_START or (m["ambiguous"] and m["alt_ordinal"] <= M.HIGHEST_START)
            if sibling or opens:
                attach(Node(named(m["kind"], m["form"]), m["token"], m["ordinal"], "", p["idx"], marker=dict(m)), sibling.level if sibling else open_nodes[-1].level + 1)
                continue
        top = open_nodes[-1]
        if top.kind in CAPTIONED and not top.title and p["idx"] == top.head + 1 and p["is_caption"]:
            top.title = p["text"]
    for node in open_nodes:
        node.end = last
    _finish(root)
    return root


def _finish(root: Node) -> None:
    """Settle each list's family, then number and name all nodes from the top."""
    stack = [root]
    while stack:
        node = stack.pop()
        by_level: dict[int, list[dict]] = {}
        for c in node.children:
            if c.marker:
                by_level.setdefault(c.level, []).append(c.marker)
        for members in by_level.values():
            settle(members)
        for c in node.children:
            if c.marker:
                c.kind, c.ordinal = named(c.marker["kind"], c.marker["form"]), c.marker["ordinal"]
                c.number = ".".join(str(int(x)) for x in c.marker["token"].split(".")) if c.marker["kind"] == "DECIMAL" else c.marker["token"]
        stack += node.children
    taken = {"root"}
    for node in walk(root):
        if node is root:
            continue
        own = f"{node.kind}:{node.number}"
        base = own if node.kind in (*ARTICLES, "bab") else f"{node.parent.ident}/{own}"
        node.ident = base
        k = 2
        while node.ident in taken:
            node.ident, k = f"{base}#{k}", k + 1
        taken.add(node.ident)


def walk(root: Node):
    """All nodes in the order of the document."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def rows_of(root: Node) -> list[tuple]:
    out = []
    for k, n in enumerate(walk(root)):
        a = n.article()
        m = n.marker or {}
        start = max(0, n.head)
        out.append((n.ident, n.parent.ident if n.parent else None, k, n.kind, n.label, n.number, n.ordinal, m.get("kind"), m.get("form"), m.get("raw"), n.level, n.head, start, max(start, n.end), n.title, n.path(), n.full_path(), a.ident if a else None, a.number if a else None, a.kind if a else None))
    return out


def read_paragraphs(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds heading (known or learned), marker, is_caption and skip, the length of a heading, to (keys, idx, text)."""
    out = paragraphs.withColumns({"heading": H.parse_heading(F.col("text")), "_word": F.lower(F.regexp_extract("text", H.LEARNED, 1))})
    learned = H.learned_vocabulary(paragraphs, keys, "idx", "text").select(*keys, F.col("word").alias("_word"), F.lit(True).alias("_learned"))
    number = F.regexp_extract("text", H.LEARNED, 2)
    own = F.struct(F.lit("article").alias("kind"), number.alias("number"), H.numerals.article_number(number).alias("ordinal"), F.trim("text").alias("label"))
    out = out.join(learned, [*keys, "_word"], "left").withColumn("heading", F.coalesce("heading", F.when(F.col("_learned"), own)))
    skip = F.when(F.col("_learned"), F.length("text")).otherwise(F.coalesce(F.length("heading.label"), F.lit(0)))
    return out.withColumns({"marker": M.parse_marker(F.col("text")), "is_caption": T.is_title_case(F.col("text")), "skip": F.when(F.col("heading").isNull(), 0).otherwise(skip)}).drop("_word", "_learned")


def build(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes of every document: keys and NODE_FIELDS; parents by id. A document is one row of its task's batches."""
    schema = ", ".join(f"`{k}` {dict(paragraphs.dtypes)[k]}" for k in keys) + ", " + NODE_FIELDS
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in NODE_FIELDS.split(", ")]
    members = F.array_sort(F.collect_list(F.struct("idx", "text", "heading", "marker", "is_caption")))
    docs = read_paragraphs(paragraphs, keys).groupBy(*keys).agg(members.alias("_paragraphs"))

    def grown(batches):
        for batch in batches:
            trees = [rows_of(grow(p)) for p in batch.column("_paragraphs").to_pylist()]
            of = pa.array([i for i, rows in enumerate(trees) for _ in rows], pa.int32())
            rows = [r for rows in trees for r in rows]
            columns = [batch.column(k).take(of) for k in keys] + [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *(n for n, _ in fields)])

    return docs.mapInArrow(grown, schema)


def owners(paragraphs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, node_id, path, article_id, article_number, article_kind) of each paragraph: the last node that begins at or before it."""
    heads = nodes.where("head_index >= 0").select(*keys, F.col("head_index").alias("idx"), F.struct("node_id", "path", "article_id", "article_number", "article_kind").alias("own"))
    joined = paragraphs.select(*keys, "idx").join(heads, [*keys, "idx"], "left")
    last = F.last("own", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("own", last).select(*keys, "idx", "own.*")


def references(paragraphs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Every citation with its target; relative ones take the article around them."""
    schema = ", ".join(f"`{k}` {dict(paragraphs.dtypes)[k]}" for k in keys) + ", " + REF_FIELDS
    read = read_paragraphs(paragraphs, keys).where("text <> ''").select(*keys, "idx", "text", "skip")
    names = [*keys, *(f.split()[0] for f in REF_FIELDS.split(", "))]

    def found(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                key = tuple(row[: len(keys)])
                for k, r in enumerate(R.extract(row.text, int(row.skip))):
                    rows.append((*key, row.idx, k, r["raw"], r["start"], r["end"], r["kind"], r["pasal"], r["ayat"], r["huruf"], r["angka"], r["lang"]))
            yield pd.DataFrame(rows, columns=names)

    refs = read.mapInPandas(found, schema)
    around = owners(paragraphs, nodes, keys).select(*keys, F.col("idx").alias("para_index"), F.col("article_number").alias("_number"), F.col("article_kind").alias("_kind"), F.col("path").alias("context"))
    out = refs.join(around, [*keys, "para_index"], "left")
    relative = (F.col("kind") == "relative") & F.col("_number").isNotNull()
    out = out.withColumn("lang", F.when(relative & (F.col("_kind") == "article"), "en").otherwise(F.col("lang"))).withColumn("pasal", F.when(relative, F.col("_number")).otherwise(F.col("pasal")))
    parts = [F.col(c) for c in ("lang", "pasal", "ayat", "huruf", "angka")]
    return out.drop("_number", "_kind").withColumns({"target_id": R.target_id(*parts), "citation": R.citation(*parts)})
