"""Comparing two versions of many documents at once.

Inputs are paragraphs (pair_id, idx, text) of the old and the new versions. All tables that come out
are keyed by pair_id; a pair's paragraphs, nodes and citations are shuffled by pair_id only. What
several later steps read is checkpointed, which also keeps their plans small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.checkpoints import checkpoint
from clausegrid.functions import headings as H
from clausegrid.functions import text as T
from clausegrid.operators import diff, integrity, numbering, parallel, report, tree

KEYS = ["pair_id"]
# What lists are called in messages.
LEVEL_LABELS = {"ayat": "ayat", "huruf": "huruf", "angka": "angka", "clause": "klausul", "item": "butir"}


def sequences(nodes: DataFrame) -> DataFrame:
    """All numbered sequences of the nodes: chapters, each heading word's articles, each parent's lists by kind and form."""
    named = nodes.where("kind <> 'root'").withColumn("keyword", F.when(F.col("kind").isin(*tree.ARTICLES), F.lower(F.btrim(F.get(F.split(F.col("label"), r"\s+"), F.lit(0)), F.lit(".:)-")))))
    is_list = F.col("marker_kind").isNotNull()
    is_article = F.col("kind").isin(*tree.ARTICLES) & ~is_list
    key = F.when(F.col("kind") == "bab", "bab").when(is_article, F.concat(F.lit("article/"), F.col("keyword"))).when(is_list, F.concat_ws("/", F.lit("list"), "parent_id", "kind", "marker_form"))
    parent = nodes.select(*KEYS, F.col("node_id").alias("parent_id"), F.col("path").alias("parent_path"), F.col("number").alias("parent_number"), F.col("kind").alias("parent_kind"))
    out = named.withColumn("seq_key", key).where("seq_key is not null").join(parent, [*KEYS, "parent_id"], "left")
    first = F.first("label").over(Window.partitionBy(*KEYS, "seq_key").orderBy("head_index"))
    labels = F.create_map(*(F.lit(x) for pair in LEVEL_LABELS.items() for x in pair))
    label = F.when(F.col("kind") == "bab", "BAB").when(is_article, F.btrim(F.get(F.split(first, r"\s+"), F.lit(0)), F.lit(".:)-"))).otherwise(F.try_element_at(labels, F.col("kind")))
    return out.select(*KEYS, "seq_key", F.col("head_index").alias("pos"), "node_id", "ordinal", "number", F.coalesce("marker_kind", F.lit("DIGIT")).alias("kind"), F.coalesce("marker_form", F.lit("BARE")).alias("form"), F.coalesce("marker_raw", "number").alias("raw"), F.col("kind").alias("node_kind"), "keyword", label.alias("seq_label"), F.when(is_list, F.coalesce("parent_path", F.lit(""))).otherwise("").alias("scope"), "parent_number", "parent_kind", "preorder", "label")


def numbering_findings(seqs: DataFrame) -> DataFrame:
    """(pair_id, category, severity, message, evidence, para_index, node_id, stage, s1, s2): defects with messages."""
    found = numbering.findings(seqs, [*KEYS, "seq_key"])
    inside = F.when(F.col("scope") != "", F.concat(F.lit(" dalam "), F.col("scope"))).otherwise("")
    label, number = F.col("seq_label"), F.col("number")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    one = numbering.numerals.format_ordinal(F.col("kind"), F.lit(1))
    message = (
        F.when(F.col("category") == numbering.DUPLICATE, say(label, " ", number, " muncul dua kali", inside, " (sebelumnya di paragraf [", F.col("holder").cast("string"), "])"))
        .when(F.col("category") == numbering.BAD_START, say("Urutan ", label, inside, " dimulai dari ", number, ", seharusnya dari ", one))
        .when(F.col("category") == numbering.OUT_OF_ORDER, say(label, " ", number, " muncul setelah ", label, " ", F.col("before_number"), inside, " — urutan mundur"))
        .otherwise(say(label, " ", F.col("missing"), " hilang", inside, " — melompat dari ", F.col("before_number"), " ke ", number))
    )
    at = lambda pos, number: say("[", pos.cast("string"), "] ", label, " ", number)
    evidence = F.when(F.col("category") == numbering.DUPLICATE, F.array(at(F.col("holder"), number), at(F.col("pos"), number))).when(F.col("category") == numbering.GAP, F.array(at(F.col("before_pos"), F.col("before_number")), at(F.col("pos"), number)))
    out = found.select(*KEYS, "category", "severity", message.alias("message"), evidence.alias("evidence"), F.col("pos").alias("para_index"), "node_id", F.lit(1).alias("stage"), F.col("check_seq").alias("s1"), F.col("pos").alias("s2"))
    clauses = seqs.where((F.col("node_kind") == "clause") & F.col("parent_kind").isin(*tree.ARTICLES))
    wrong = numbering.prefix_mismatches(clauses)
    text = say("Klausul ", number, " berada di bawah ", F.col("scope"), " tetapi diawali ", F.col("got"), ", seharusnya ", F.col("parent_number"))
    return out.unionByName(wrong.select(*KEYS, "category", "severity", text.alias("message"), F.lit(None).cast("array<string>").alias("evidence"), F.col("pos").alias("para_index"), "node_id", F.lit(1).alias("stage"), F.lit(9).alias("s1"), F.col("pos").alias("s2")))


def parallel_findings(seqs: DataFrame) -> DataFrame:
    heads = seqs.where(F.col("node_kind").isin(*tree.ARTICLES)).select(*KEYS, "keyword", "pos", "ordinal", "number", "label", "node_id")
    wrong = parallel.mismatches(heads, KEYS).join(parallel.describe(heads, KEYS), KEYS)
    count = F.concat(F.lit("Jumlah judul antar-bagian tidak sama ("), F.col("counts"), F.lit('). "'), F.col("keyword"), F.lit('" '), F.col("number"), F.lit(" tidak punya pasangan"))
    place = F.concat(F.lit("Penomoran antar-bagian tidak sinkron pada urutan ke-"), F.col("place").cast("string"), F.lit(': "'), F.col("base_keyword"), F.lit('" '), F.col("base_number"), F.lit(' berpasangan dengan "'), F.col("keyword"), F.lit('" '), F.col("number"))
    at = lambda pos, label: F.concat(F.lit("["), F.col(pos).cast("string"), F.lit("] "), F.col(label))
    evidence = F.when(F.col("problem") == "count", F.col("counted")).otherwise(F.array(at("base_pos", "base_label"), at("pos", "label")))
    return wrong.select(*KEYS, "category", "severity", F.when(F.col("problem") == "count", count).otherwise(place).alias("message"), evidence.alias("evidence"), F.col("pos").alias("para_index"), "node_id", F.lit(2).alias("stage"), F.when(F.col("problem") == "count", 0).otherwise(1).alias("s1"), F.col("pos").alias("s2"), "problem")


def reference_findings(prev: dict[str, DataFrame], curr: dict[str, DataFrame]) -> DataFrame:
    """Broken and shifted citations and removed articles, with the edit that would repoint one."""
    refs = integrity.resolve(curr["refs"], curr["nodes"], KEYS, "in_curr").where("not in_curr")
    refs = integrity.quoted(refs, curr["paragraphs"], KEYS)
    refs = checkpoint(integrity.resolve(refs, prev["nodes"], KEYS, "in_prev").withColumn("in_prev", F.col("in_prev") & (F.col("target_id") != "")))
    removed = integrity.removed(prev["nodes"], curr["nodes"], KEYS)
    wanted = refs.where("in_prev").select(*KEYS, F.col("target_id").alias("node_id")).unionByName(removed.select(*KEYS, "node_id")).distinct()
    old = integrity.node_text(prev["nodes"].join(wanted, [*KEYS, "node_id"], "left_semi"), prev["paragraphs"], KEYS).join(prev["nodes"].select(*KEYS, "node_id", "kind"), [*KEYS, "node_id"])
    new = integrity.node_text(curr["nodes"].where("kind <> 'root'"), curr["paragraphs"], KEYS).join(curr["nodes"].select(*KEYS, "node_id", "kind", "preorder"), [*KEYS, "node_id"])
    moved = integrity.relocations(old.select(*KEYS, "kind", F.col("node_id").alias("gone_id"), F.col("node_text").alias("text")), new.select(*KEYS, "kind", F.col("node_id").alias("cand_id"), "preorder", F.col("node_text").alias("text")), [*KEYS, "kind"])
    to = moved.join(curr["nodes"].select(*KEYS, F.col("node_id").alias("cand_id"), F.col("number").alias("new_number"), F.col("path").alias("new_path")), [*KEYS, "cand_id"]).select(*KEYS, F.col("gone_id").alias("target_id"), "cand_id", "new_number", "new_path")
    to = checkpoint(to)
    cited = refs.join(to, [*KEYS, "target_id"], "left")
    cited = cited.withColumn("x", integrity.decide(F.col("in_curr"), F.col("in_prev"), F.col("cand_id").isNotNull()))
    para = F.concat(F.lit("Paragraf ["), F.col("para_index").cast("string"), F.lit("] merujuk ke "), F.col("citation"))
    message = (
        F.when(F.col("x.severity") == "minor", F.concat(F.lit("Referensi ke "), F.col("citation"), F.lit(" tidak dapat ditemukan (sudah bermasalah sejak versi sebelumnya)")))
        .when(F.col("x.category") == "shifted_reference", F.concat(para, F.lit(", yang sudah tidak ada di versi baru. Isinya tampak dipindahkan ke "), F.col("new_path")))
        .otherwise(F.concat(para, F.lit(", yang dihapus di versi baru — referensi menjadi menggantung")))
    )
    fixed = integrity.repoint(F.col("raw"), F.col("pasal"), F.col("new_number"))
    action = F.when(F.col("x.action") == "reference_update", F.when(fixed.isNotNull(), "reference_update").otherwise("")).otherwise(F.col("x.action"))
    one = cited.select(*KEYS, "x.category", "x.severity", message.alias("message"), "evidence", "para_index", F.coalesce("cand_id", F.lit("")).alias("node_id"), F.lit("curr").alias("side"), F.lit(3).alias("stage"), F.col("para_index").alias("s1"), F.col("ref_seq").alias("s2"), action.alias("action"), F.col("raw").alias("old"), F.when(F.col("x.category") == "shifted_reference", fixed).alias("new"))
    gone = removed.join(to.select(*KEYS, F.col("target_id").alias("node_id"), "new_path"), [*KEYS, "node_id"], "left")
    said = F.concat(F.col("path"), F.lit(" tidak lagi ada di versi baru"), F.when(F.col("new_path").isNotNull(), F.concat(F.lit("; isinya tampak menjadi "), F.col("new_path"))).otherwise(""))
    none = F.lit(None).cast("string")
    two = gone.select(*KEYS, F.lit("section_removed").alias("category"), F.when(F.col("new_path").isNotNull(), "minor").otherwise("major").alias("severity"), said.alias("message"), F.lit(None).cast("array<string>").alias("evidence"), F.col("head_index").alias("para_index"), "node_id", F.lit("prev").alias("side"), F.lit(4).alias("stage"), F.col("preorder").alias("s1"), F.lit(0).alias("s2"), F.lit("").alias("action"), none.alias("old"), none.alias("new"))
    return one.unionByName(two)


def structure(paragraphs: DataFrame) -> dict[str, DataFrame]:
    paragraphs = checkpoint(paragraphs.select(*KEYS, "idx", "text"))
    nodes = checkpoint(tree.build(paragraphs, KEYS))
    return {"paragraphs": paragraphs, "nodes": nodes, "refs": checkpoint(tree.references(paragraphs, nodes, KEYS))}


def compare(prev_paragraphs: DataFrame, curr_paragraphs: DataFrame) -> dict[str, DataFrame]:
    """changes, findings (ordered, with one action at most), plan, plan_summary, plan_warnings, summary and view of every pair."""
    prev, curr = structure(prev_paragraphs), structure(curr_paragraphs)
    changes = checkpoint(diff.paragraph_changes(prev["paragraphs"], curr["paragraphs"], KEYS))
    own = lambda side, column: tree.owners(side["paragraphs"], side["nodes"], KEYS).select(*KEYS, F.col("idx").alias(f"_{column}"), F.struct("path", "node_id").alias(column))
    changes = changes.withColumns({"_new": F.get("curr_indexes", F.lit(0)), "_old": F.get("prev_indexes", F.lit(0))})
    changes = changes.join(own(curr, "new"), [*KEYS, "_new"], "left").join(own(prev, "old"), [*KEYS, "_old"], "left")
    owner = F.when(F.col("new.node_id").isNotNull(), F.col("new")).otherwise(F.col("old"))
    changes = changes.withColumns({"context": F.coalesce(owner["path"], F.lit("")), "node_id": F.coalesce(owner["node_id"], F.lit(""))}).drop("_new", "_old", "new", "old")
    changes = checkpoint(changes.withColumn("title", T.change_title(F.col("type"), F.col("cosmetic"), F.col("prev_text"), F.col("curr_text"), F.col("context"))))

    seqs = checkpoint(sequences(curr["nodes"]))
    planned = numbering.plan(seqs, [*KEYS, "seq_key"])
    actions = numbering.first_actions(planned, [*KEYS, "pos"], ["preorder"]).select(*KEYS, F.col("pos").alias("para_index"), F.col("old_text").alias("old"), F.col("new_text").alias("new"), F.lit("renumber").alias("action"))
    numbered = numbering_findings(seqs).join(actions, [*KEYS, "para_index"], "left").withColumn("side", F.lit("curr"))
    beside = parallel_findings(seqs).withColumns({"side": F.lit("curr"), "action": F.when(F.col("problem") == "count", "delete"), "old": F.lit(None).cast("string"), "new": F.lit(None).cast("string")}).drop("problem")
    found = checkpoint(numbered.unionByName(beside.select(numbered.columns)).unionByName(reference_findings(prev, curr).select(numbered.columns)))
    found = found.withColumns({"class": F.lit("verified"), "confidence": F.lit(1.0), "action": F.coalesce("action", F.lit(""))})
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("stage", "s1", "s2", "category", "node_id"))
    found = found.withColumn("id", F.concat("category", F.lit("-"), nth.cast("string"))).withColumn("n_actions", (F.col("action") != "").cast("int"))
    found = checkpoint(report.attach(report.ordered(found, KEYS), changes, KEYS))

    after = numbering.apply_plan(planned)
    left = numbering.findings(after.select(seqs.columns), [*KEYS, "seq_key"])
    counts = report.counters(found, KEYS)
    sides = [side["nodes"].groupBy(*KEYS).agg(F.count_if(F.col("kind").isin(*tree.ARTICLES)).alias(name)) for side, name in ((prev, "prev_articles"), (curr, "curr_articles"))]
    summary = sides[0].join(sides[1], KEYS, "full").join(report.summarize(changes, KEYS), KEYS, "left").join(counts, KEYS, "left").na.fill(0)
    summary = summary.withColumn("exit_code", report.exit_code(F.col("critical"), F.col("major")))
    return {"changes": changes, "findings": found, "plan": actions, "plan_summary": numbering.summary(planned, [*KEYS, "seq_key", "seq_label", "scope"]), "plan_warnings": left, "summary": summary, "prev": prev["nodes"], "curr": curr["nodes"], "refs": curr["refs"]}


def inspect(paragraphs: DataFrame) -> dict[str, DataFrame]:
    """The tree, the citations, those that lead nowhere (as findings) and the learned heading words of single documents."""
    found = structure(paragraphs)
    broken = integrity.quoted(integrity.check(found["refs"], found["nodes"], KEYS), found["paragraphs"], KEYS)
    broken = broken.select(*KEYS, F.concat("category", F.lit("-"), F.col("para_index").cast("string"), F.lit("-"), F.col("ref_seq").cast("string")).alias("id"), F.lit("verified").alias("class"), "category", "severity", "message", "evidence", "para_index", "citation", F.lit(1.0).alias("confidence"))
    return {"nodes": found["nodes"], "refs": found["refs"], "findings": report.ordered(broken, KEYS), "vocabulary": H.learned_vocabulary(paragraphs, KEYS, "idx", "text")}
