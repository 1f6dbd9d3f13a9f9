"""Queries of joins, set operations, reports, grounding and advisory gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import advisory, diff, grounding, integrity, report

from .catalog import LINES_SQL, lines, longs, query, sequences, table
from .numbering_queries import _CHECKS
from .text_queries import aggressive_sql, bare_sql

# Two versions of an order book: all orders before, without the finished ones after; line items cite orders.
_CITES = "r AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 10 + l_linenumber % 10 AS BIGINT) AS ref_id, '' || (CASE l_linenumber WHEN 7 THEN l_orderkey + 1000000 ELSE l_orderkey END) AS pasal, CASE l_linenumber WHEN 5 THEN '2' ELSE '' END AS ayat FROM lineitem)"
_NODES = "prev AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'pasal:' ELSE 'article:' END || o_orderkey AS node_id FROM orders), curr AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'pasal:' ELSE 'article:' END || o_orderkey AS node_id FROM orders WHERE o_orderstatus <> 'F')"
_RESOLVED = f"""WITH {_CITES}, {_NODES},
 x AS (SELECT r.*, ayat = '' AND (EXISTS (SELECT 1 FROM curr WHERE node_id = 'pasal:' || pasal) OR EXISTS (SELECT 1 FROM curr WHERE node_id = 'article:' || pasal)) AS in_curr,
  ayat = '' AND (EXISTS (SELECT 1 FROM prev WHERE node_id = 'pasal:' || pasal) OR EXISTS (SELECT 1 FROM prev WHERE node_id = 'article:' || pasal)) AS in_prev FROM r)"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    ident = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "pasal:").otherwise("article:"), F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "pasal").otherwise("article")
    prev = o.select(F.lit(0).alias("pair"), ident.alias("node_id"), kind.alias("kind"), "o_orderstatus", "o_orderkey")
    return prev, prev.where("o_orderstatus <> 'F'")


def _refs(spark, d):
    li = table(spark, d, "lineitem")
    pasal = F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + 1000000).otherwise(F.col("l_orderkey")).cast("string")
    r = li.select(F.lit(0).alias("pair"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 10).alias("ref_id"), pasal.alias("pasal"), F.when(F.col("l_linenumber") == 5, "2").otherwise("").alias("ayat"), F.lit("").alias("huruf"), F.lit("").alias("angka"))
    from clausegrid.functions import references as R

    return r.withColumn("target_id", R.target_id(F.lit("id"), *(F.col(c) for c in ("pasal", "ayat", "huruf", "angka"))))


def _resolved(spark, d):
    prev, curr = _versions(spark, d)
    refs = integrity.resolve(_refs(spark, d), curr, ["pair"], "in_curr")
    return integrity.resolve(refs, prev, ["pair"], "in_prev")


@query("broken_refs", f"""{_RESOLVED} SELECT l_orderkey, ref_id, CASE WHEN NOT in_prev THEN 'minor' ELSE 'critical' END AS severity, CASE WHEN NOT in_prev THEN '' ELSE 'manual_review' END AS action, CAST(count(*) AS BIGINT) AS n FROM x WHERE NOT in_curr GROUP BY ALL""")
def broken_refs(spark, d):
    x = integrity.decide(F.col("in_curr"), F.col("in_prev"), F.lit(False))
    return _resolved(spark, d).withColumn("x", x).where("x is not null").groupBy("l_orderkey", "ref_id", "x.severity", "x.action").agg(F.count("*").alias("n"))


@query("single_document_refs", f"{_RESOLVED} SELECT ref_id, 'broken_reference' AS category, 'major' AS severity, 'Referensi ke Pasal ' || pasal || CASE WHEN ayat <> '' THEN ' ayat (' || ayat || ')' ELSE '' END || ' tidak dapat ditemukan dalam dokumen' AS message, CAST(count(*) AS BIGINT) AS n FROM x WHERE NOT in_curr GROUP BY ALL")
def single_document_refs(spark, d):
    """Citations that lead nowhere, without an older version to hold them against."""
    from clausegrid.functions import references as R

    refs = _refs(spark, d).withColumn("citation", R.citation(F.lit("id"), *(F.col(c) for c in ("pasal", "ayat", "huruf", "angka"))))
    return integrity.check(refs, _versions(spark, d)[1], ["pair"]).groupBy("ref_id", "category", "severity", "message").agg(F.count("*").alias("n"))


@query("ref_evidence", f"""WITH {LINES_SQL}, r AS (SELECT doc_id, idx, text, strpos(text, ' the ') - 1 AS a, strpos(text, ' the ') + 4 AS b FROM lines WHERE contains(text, ' the '))
SELECT doc_id, idx AS para_index, '[' || idx || '] ' || CASE WHEN a > 60 THEN '...' ELSE '' END || substr(text, greatest(a - 60, 0) + 1, least(b + 60, length(text)) - greatest(a - 60, 0)) || CASE WHEN b + 60 < length(text) THEN '...' ELSE '' END AS evidence FROM r""")
def ref_evidence(spark, d):
    """What stands around the first `` the `` of every line, as a citation would be quoted."""
    p = lines(spark, d)
    at = F.instr("text", " the ")
    refs = p.where(at > 0).select("doc_id", F.col("idx").alias("para_index"), (at - 1).alias("start"), (at + 4).alias("end"), F.lit(" the ").alias("raw"))
    return integrity.quoted(refs, p, ["doc_id"]).select("doc_id", "para_index", F.col("evidence")[0].alias("evidence"))


@query("ref_history", f"{_RESOLVED} SELECT in_curr, in_prev, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL")
def ref_history(spark, d):
    return _resolved(spark, d).groupBy("in_curr", "in_prev").agg(F.count("*").alias("n"))


@query("removed_nodes", "SELECT CASE o_orderkey % 2 WHEN 0 THEN 'pasal:' ELSE 'article:' END || o_orderkey AS node_id, 'section_removed' AS category FROM orders WHERE o_orderstatus = 'F'")
def removed_nodes(spark, d):
    prev, curr = _versions(spark, d)
    return integrity.removed(prev, curr, ["pair"]).select("node_id", F.lit("section_removed").alias("category"))


@query("relocation_jaccard", f"""
WITH t AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split({aggressive_sql('text')}, ' '), lambda w: w <> '')) AS toks, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS fields FROM documents),
 g AS (SELECT * FROM t WHERE source IN ('src1', 'src2', 'src3') AND fields >= 5), c AS (SELECT * FROM t WHERE source NOT IN ('src1', 'src2', 'src3')),
 p AS (SELECT g.doc_id AS gone_id, c.doc_id AS cand_id, len(list_intersect(g.toks, c.toks)) AS shared, len(g.toks) + len(c.toks) AS total FROM g JOIN c ON g.lang = c.lang AND len(g.toks) > 0.75 * len(c.toks) AND len(c.toks) > 0.75 * len(g.toks)),
 s AS (SELECT gone_id, cand_id, shared / (total - shared) AS score FROM p WHERE shared / (total - shared) > 0.75)
SELECT gone_id, cand_id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY gone_id ORDER BY score DESC, cand_id) = 1
""")
def relocation_jaccard(spark, d):
    """Documents of three sources that vanished, and the most similar one elsewhere in their language."""
    docs = table(spark, d, "documents")
    old = F.col("source").isin("src1", "src2", "src3")
    gone = docs.where(old).select("lang", F.col("doc_id").alias("gone_id"), "text")
    rest = docs.where(~old).select("lang", F.col("doc_id").alias("cand_id"), F.col("doc_id").alias("preorder"), "text")
    return integrity.relocations(gone, rest, ["lang"]).select("gone_id", "cand_id", F.round("score", 4).alias("score"))


@query("node_text", f"WITH s AS (SELECT l_orderkey AS seq_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT seq_key, string_agg(p_name, ' ' ORDER BY pos) AS node_text FROM s GROUP BY seq_key")
def node_text(spark, d):
    from .catalog import ORDER

    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    p = li.select(F.col("l_orderkey").alias("seq_key"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).alias("idx"), F.col("p_name").alias("text"))
    nodes = p.select("seq_key").distinct().select("seq_key", F.lit("n").alias("node_id"), F.lit(1).alias("start"), F.lit(1 << 30).alias("end"))
    return integrity.node_text(nodes, p, ["seq_key"]).select("seq_key", "node_text")


_A, _B = "source IN ('src0', 'src1', 'src2', 'src3', 'src4')", "source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4')"
_SIDES = f"WITH {LINES_SQL}, a AS (SELECT lines.text FROM lines JOIN documents USING (doc_id) WHERE {_A}), b AS (SELECT lines.text FROM lines JOIN documents USING (doc_id) WHERE {_B})"


@query("exact_multiset_diff", f"""{_SIDES}, u AS (SELECT 'removed' AS type, text FROM (SELECT text FROM a EXCEPT ALL SELECT text FROM b) x UNION ALL SELECT 'added', text FROM (SELECT text FROM b EXCEPT ALL SELECT text FROM a) y UNION ALL SELECT 'same', text FROM (SELECT text FROM a INTERSECT ALL SELECT text FROM b) z)
SELECT type, text, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY type, text""")
def exact_multiset_diff(spark, d):
    docs = table(spark, d, "documents").withColumn("line", F.explode(F.split("text", "\n", -1)))
    a, b = docs.where(_A).select(F.col("line").alias("text")), docs.where(_B).select(F.col("line").alias("text"))
    named = lambda df, kind: df.select(F.lit(kind).alias("type"), "text")
    u = named(a.exceptAll(b), "removed").unionByName(named(b.exceptAll(a), "added")).unionByName(named(a.intersectAll(b), "same"))
    return u.groupBy("type", "text").agg(F.count("*").alias("n"))


# Two versions of a document by position: its lines, and the same with some changed, cut or added.
_EDIT = "CASE WHEN (doc_id + idx) % 11 = 0 THEN replace(text, ',', '') WHEN (doc_id + idx) % 7 = 0 THEN upper(text) ELSE text END"
_CHANGES = f"""WITH {LINES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
 b AS (SELECT doc_id, idx, {_EDIT} AS text FROM lines JOIN n USING (doc_id) WHERE NOT (doc_id % 3 = 0 AND idx = n - 1 AND idx > 0) UNION ALL SELECT doc_id, n, 'Tambahan.' FROM n WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0),
 c AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.idx, y.idx) AS idx, x.text AS p, y.text AS q FROM lines x FULL JOIN b y ON x.doc_id = y.doc_id AND x.idx = y.idx WHERE x.text IS DISTINCT FROM y.text),
 k AS (SELECT doc_id, idx, CASE WHEN p IS NULL THEN 'added' WHEN q IS NULL THEN 'removed' ELSE 'modified' END AS type, coalesce(p <> '' AND q <> '' AND {bare_sql('p')} = {bare_sql('q')}, false) AS cosmetic FROM c)"""


def _changes(spark, d):
    a = lines(spark, d)
    n = a.groupBy("doc_id").agg(F.count("*").alias("n"))
    b = a.join(n, "doc_id").where("not (doc_id % 3 = 0 and idx = n - 1 and idx > 0)").select("doc_id", "idx", F.expr(_EDIT).alias("text"))
    more = n.where("doc_id % 5 = 0 and doc_id % 3 <> 0").select("doc_id", F.col("n").alias("idx"), F.lit("Tambahan.").alias("text"))
    return diff.positional_changes(a, b.unionByName(more), ["doc_id"], "idx")


@query("change_summary", f"{_CHANGES} SELECT doc_id, CAST(count(*) FILTER (type = 'added') AS BIGINT) AS added, CAST(count(*) FILTER (type = 'removed') AS BIGINT) AS removed, CAST(count(*) FILTER (type = 'modified') AS BIGINT) AS modified, CAST(count(*) AS BIGINT) AS total FROM k GROUP BY doc_id")
def change_summary(spark, d):
    return report.summarize(_changes(spark, d), ["doc_id"])


@query("substantive_topk", f"{_CHANGES} SELECT doc_id, idx, type FROM k WHERE NOT cosmetic QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) <= 25")
def substantive_topk(spark, d):
    c = _changes(spark, d).withColumnRenamed("idx", "change_id")
    return report.substantive(c, ["doc_id"]).select("doc_id", F.col("change_id").alias("idx"), "type")


@query("paragraph_diff")
def paragraph_diff(spark, d):
    """Aligned changes between each document and its edited version; an edit script has no SQL form."""
    a = lines(spark, d)
    kept = a.where("not (doc_id % 3 = 0 and idx % 9 = 4)").select("doc_id", "idx", F.expr(_EDIT).alias("text"))
    return longs(diff.paragraph_changes(a, kept, ["doc_id"]), "change_id").select("doc_id", "change_id", "type", "prev_text", "curr_text", "prev_html", "curr_html", "cosmetic")


# Findings are an order's numbering defects; changes are its returned line items.
_FOUND = f"""{_CHECKS}, f AS (SELECT seq_key, pos, 'numbering_duplicate' AS category, 'major' AS severity FROM c WHERE n > 1 AND times > 1 UNION ALL SELECT seq_key, pos, 'numbering_bad_start', 'minor' FROM c WHERE n > 1 AND pos = 1 AND ordinal <> 1
 UNION ALL SELECT seq_key, pos, 'numbering_out_of_order', 'major' FROM c WHERE n > 1 AND ordinal < before UNION ALL SELECT seq_key, pos, 'numbering_gap', 'major' FROM c WHERE n > 1 AND ordinal > before + 1)"""
_ATTACH = f"""{_FOUND},
 g AS (SELECT seq_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos, l_returnflag, l_linenumber FROM (SELECT l_orderkey AS seq_key, * FROM lineitem) l),
 ch AS (SELECT seq_key, pos * 10 AS change_id, pos, 'pasal:' || l_linenumber AS node_id FROM g WHERE l_returnflag = 'R'),
 fn AS (SELECT f.*, 'pasal:' || c.ordinal || CASE WHEN f.pos % 2 = 0 THEN '' ELSE '/ayat:1' END AS node_id FROM f JOIN c USING (seq_key, pos)),
 bn AS (SELECT seq_key, node_id, min(change_id) AS by_node FROM ch GROUP BY ALL), ba AS (SELECT seq_key, node_id AS article, min(change_id) AS by_article FROM ch GROUP BY ALL HAVING count(*) = 1),
 x AS (SELECT fn.*, coalesce(ch.change_id, by_node, by_article) AS change_id FROM fn LEFT JOIN ch ON ch.seq_key = fn.seq_key AND ch.pos = fn.pos LEFT JOIN bn ON bn.seq_key = fn.seq_key AND bn.node_id = fn.node_id LEFT JOIN ba ON ba.seq_key = fn.seq_key AND ba.article = split_part(fn.node_id, '/', 1))"""


def _found(spark, d):
    from clausegrid.operators import numbering

    return numbering.findings(sequences(spark, d), ["seq_key"])


def _attached(spark, d):
    from .catalog import ORDER

    f = _found(spark, d)
    f = f.select("seq_key", F.col("pos").alias("para_index"), F.lit("").alias("side"), F.concat(F.lit("pasal:"), F.col("ordinal").cast("string"), F.when(F.col("pos") % 2 == 0, "").otherwise("/ayat:1")).alias("node_id"), "category", "severity", F.lit(1).alias("n_actions"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq_key"), pos.alias("pos"), "l_returnflag", "l_linenumber").where("l_returnflag = 'R'")
    c = c.select("seq_key", (F.col("pos") * 10).alias("change_id"), F.array("pos").alias("curr_indexes"), F.array().cast("array<bigint>").alias("prev_indexes"), F.concat(F.lit("pasal:"), F.col("l_linenumber").cast("string")).alias("node_id"))
    return report.attach(f, c, ["seq_key"])


@query("attach_findings", f"{_ATTACH} SELECT seq_key, pos, category, CAST(change_id AS BIGINT) AS change_id FROM x")
def attach_findings(spark, d):
    return _attached(spark, d).select("seq_key", F.col("para_index").alias("pos"), "category", "change_id")


@query("warnings_split", f"{_ATTACH} SELECT category, CAST(count(*) FILTER (change_id IS NOT NULL) AS BIGINT) AS attached, CAST(count(*) FILTER (change_id IS NULL) AS BIGINT) AS warnings FROM x GROUP BY category")
def warnings_split(spark, d):
    return _attached(spark, d).groupBy("category").agg(F.count("change_id").alias("attached"), F.count_if(F.col("change_id").isNull()).alias("warnings"))


@query("severity_sort", f"{_FOUND} SELECT seq_key, pos, category, CAST(row_number() OVER (PARTITION BY seq_key ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, pos, category) AS BIGINT) AS place FROM f")
def severity_sort(spark, d):
    return longs(report.ordered(_found(spark, d), ["seq_key"], "pos", "category"), "place").select("seq_key", "pos", "category", "place")


@query("findings_by_category", f"{_FOUND} SELECT category, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT seq_key) AS BIGINT) AS orders, max(pos) AS last_pos FROM f GROUP BY category")
def findings_by_category(spark, d):
    return _found(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("seq_key").alias("orders"), F.max("pos").alias("last_pos"))


@query("verified_facts", f"{_FOUND}, k AS (SELECT seq_key, string_agg(category, '; ' ORDER BY pos, category) AS facts, count(*) AS n FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY seq_key ORDER BY pos, category) <= 20) q GROUP BY seq_key), t AS (SELECT seq_key, count(*) AS total FROM f GROUP BY seq_key) SELECT seq_key, facts || CASE WHEN total > 20 THEN ' (dan ' || (total - 20) || ' lainnya)' ELSE '' END AS facts FROM k JOIN t USING (seq_key)")
def verified_facts(spark, d):
    f = _found(spark, d)
    first = report.first_by(f, ["seq_key"], ["pos", "category"], report.MAX_FACTS).groupBy("seq_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category"))), lambda x: x["category"]), "; ").alias("facts"))
    total = f.groupBy("seq_key").agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > report.MAX_FACTS, F.concat(F.lit(" (dan "), (F.col("total") - report.MAX_FACTS).cast("string"), F.lit(" lainnya)"))).otherwise("")
    return first.join(total, "seq_key").select("seq_key", F.concat("facts", more).alias("facts"))


# Edits that quote a line of a document: verbatim, respaced, invented, empty, or changing nothing.
_ACTION = "SELECT doc_id, idx, text, idx % 6 AS k, CASE idx % 6 WHEN 0 THEN substr(text, 3, 20) WHEN 1 THEN replace(substr(text, 1, 30), ' ', '  ') WHEN 2 THEN 'tidak ada ' || doc_id WHEN 3 THEN '  ' ELSE substr(text, 1, 10) END AS old, CASE idx % 6 WHEN 4 THEN substr(text, 1, 10) ELSE 'baru' END AS new, CASE idx % 6 WHEN 5 THEN idx + 100000 ELSE idx END AS para FROM lines"
_GROUND = f"""WITH {LINES_SQL}, a AS ({_ACTION}),
 v AS (SELECT doc_id, idx, CASE WHEN k = 5 THEN 'out_of_range' WHEN trim(old) = '' THEN 'empty_old' WHEN NOT (contains(text, old) OR contains({aggressive_sql('text')}, {aggressive_sql('old')})) THEN 'not_found' WHEN old = new THEN 'no_change' END AS reason FROM a)"""


def _grounded(spark, d):
    p = lines(spark, d)
    k = F.col("idx") % 6
    old = F.when(k == 0, F.substring("text", 3, 20)).when(k == 1, F.replace(F.substring("text", 1, 30), F.lit(" "), F.lit("  "))).when(k == 2, F.concat(F.lit("tidak ada "), F.col("doc_id").cast("string"))).when(k == 3, "  ").otherwise(F.substring("text", 1, 10))
    a = p.select("doc_id", "idx", F.lit("replacement").alias("type"), old.alias("old"), F.when(k == 4, F.substring("text", 1, 10)).otherwise("baru").alias("new"), F.when(k == 5, F.col("idx") + 100000).otherwise(F.col("idx")).alias("paragraph_index"))
    return grounding.ground_actions(a.withColumnRenamed("idx", "action"), p, ["doc_id"])


@query("ground_actions", f"{_GROUND} SELECT doc_id, idx AS action, reason FROM v")
def ground_actions(spark, d):
    return _grounded(spark, d).select("doc_id", "action", "reason")


@query("ground_findings", f"{_GROUND} SELECT doc_id, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS accepted, CAST(count(reason) AS BIGINT) AS rejected, CAST(CASE WHEN count(*) FILTER (reason IS NULL) = 0 AND count(reason) > 0 THEN 0.4 ELSE 0.8 END AS DOUBLE) AS confidence FROM v GROUP BY doc_id")
def ground_findings(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.lit(0.8).alias("confidence"))
    out = grounding.ground_findings(f, _grounded(spark, d), ["doc_id"])
    return out.select("doc_id", "accepted", "rejected", F.round("confidence", 4).alias("confidence"))


@query("ground_feedback", f"{_GROUND} SELECT doc_id, string_agg('#' || idx || ': ' || reason, chr(10) ORDER BY idx) AS feedback FROM v WHERE reason IS NOT NULL GROUP BY doc_id")
def ground_feedback(spark, d):
    return grounding.feedback(_grounded(spark, d), ["doc_id"], "action")


@query("ground_quotes", """
SELECT item_id, CAST(count(doc_id) AS BIGINT) AS holders, min(doc_id) AS first_doc FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id
""")
def ground_quotes(spark, d):
    """Documents that hold a benchmark passage verbatim; the passages are a stated set against all rows, sent where their size is checked."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    small = (items.agg(F.sum(F.octet_length("quote"))).first()[0] or 0) <= 8 << 20
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = docs.join(F.broadcast(items) if small else items, F.col("text").contains(F.col("quote"))).groupBy("item_id").agg(F.count("*").alias("holders"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("holders", F.lit(0).cast("long")).alias("holders"), "first_doc")


# Labels as verdicts: quality says whether a document's changes are of substance, toxic names its lines 1 and 2.
_OFFER = f"WITH {LINES_SQL}, o AS (SELECT doc_id, idx AS change_id FROM lines)"


@query("triage_route", """
SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 OR l.doc_id IS NULL OR l.quality = 0 OR l.toxic = 0 THEN 'assemble' ELSE 'analyze' END AS route FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def triage_route(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    has = F.coalesce("has", F.lit(False))
    route = advisory.route(F.col("doc_id") % 9 == 0, has, F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce("toxic", F.lit(0)))
    return joined.select("doc_id", route.alias("route"))


def _verdicts(spark, d):
    ids = F.when(F.col("toxic") == 1, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("substantive"), ids.alias("ids"))


def _offered(spark, d):
    return lines(spark, d).select("doc_id", F.col("idx").alias("change_id"))


@query("triaged_changes", f"{_OFFER} SELECT o.doc_id, change_id FROM o LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR (quality = 1 AND (toxic = 0 OR change_id IN (1, 2)))")
def triaged_changes(spark, d):
    return advisory.triaged(_offered(spark, d), _verdicts(spark, d), ["doc_id"])


_KIND = "['typo', 'penalty_change', 'formatting', 'liability_shift', 'nonsense'][CAST(event_id % 5 AS INT) + 1]"
_SEV = "CASE event_id % 4 WHEN 0 THEN 'Kritis' WHEN 1 THEN 'info' WHEN 2 THEN 'mayor' ELSE 'x' END"
_ADVICE = f"""WITH a AS (SELECT event_id, user_id, event_id % 40 AS change_id, {_KIND} AS kind, {_SEV} AS sev, value FROM events),
 v AS (SELECT event_id, user_id, change_id, kind, CASE sev WHEN 'Kritis' THEN 'critical' WHEN 'info' THEN 'info' WHEN 'mayor' THEN 'major' ELSE 'minor' END AS severity, value FROM a WHERE kind <> 'nonsense' AND EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.user_id = a.user_id AND o.event_id % 40 = a.change_id)),
 r AS (SELECT * FROM v WHERE kind NOT IN ('typo', 'formatting') AND severity <> 'info')"""


def _analyses(spark, d):
    e = table(spark, d, "events")
    kinds = F.array(*map(F.lit, ["typo", "penalty_change", "formatting", "liability_shift", "nonsense"]))
    a = e.select("event_id", "user_id", (F.col("event_id") % 40).alias("change_id"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("kind"), F.expr(_SEV).alias("severity"), "value")
    offered = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 40).alias("change_id")).distinct()
    return advisory.keep_valid(a, offered, ["user_id"])


@query("keep_valid_analyses", f"{_ADVICE} SELECT event_id, kind, severity FROM v")
def keep_valid_analyses(spark, d):
    return _analyses(spark, d).select("event_id", "kind", "severity")


@query("risky_analyses", f"{_ADVICE} SELECT event_id, kind, severity FROM r")
def risky_analyses(spark, d):
    return advisory.risky(_analyses(spark, d)).select("event_id", "kind", "severity")


@query("advisory_build", f"""{_ADVICE}, rec AS (SELECT * FROM r WHERE event_id % 2 = 1)
SELECT user_id, 'advisory-risk-' || event_id AS id, 'legal_risk' AS category, change_id, severity, round(greatest(0.0, least(1.0, value / 50)), 4) AS confidence FROM rec
UNION ALL SELECT r.user_id, 'advisory-change-' || r.change_id, 'meaning_change', r.change_id, r.severity, round(greatest(0.0, least(1.0, r.value / 50)), 4) FROM r WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.user_id = r.user_id AND rec.change_id = r.change_id)""")
def advisory_build(spark, d):
    risky = advisory.risky(_analyses(spark, d)).withColumns({"message": F.lit("m"), "confidence": F.col("value") / 50})
    rec = risky.where("event_id % 2 = 1").withColumn("rec_no", F.col("event_id"))
    out = advisory.build(risky, rec, ["user_id"])
    return out.select("user_id", "id", "category", "change_id", "severity", F.round("confidence", 4).alias("confidence"))


@query("advisory_places", """
WITH f AS (SELECT conv_id, turn, turn + 1 AS change_id, CASE WHEN turn % 4 = 0 THEN 99 END AS own FROM conversations),
 c AS (SELECT conv_id, turn AS change_id, 'pasal:' || turn AS node_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 2 END AS first_at FROM conversations)
SELECT f.conv_id, CAST(turn AS BIGINT) AS turn, CAST(coalesce(own, first_at) AS BIGINT) AS para_index, coalesce(node_id, '') AS node_id FROM f LEFT JOIN c USING (conv_id, change_id)""")
def advisory_places(spark, d):
    """Each turn as advice on the change that is the next turn; every third change touches no paragraph of the new version."""
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    advice = t.select("conv_id", "turn", (F.col("turn") + 1).alias("change_id"), F.when(F.col("turn") % 4 == 0, 99).cast("long").alias("paragraph_index"))
    indexes = F.when(F.col("turn") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("turn") * 2, F.col("turn") * 2 + 1))
    changes = t.select("conv_id", F.col("turn").alias("change_id"), F.concat(F.lit("pasal:"), F.col("turn").cast("string")).alias("node_id"), indexes.alias("curr_indexes"))
    return advisory.placed(advice, changes, ["conv_id"]).select("conv_id", "turn", "para_index", "node_id")


@query("assemble_report", f"""WITH {LINES_SQL},
 v AS (SELECT doc_id, 'v-' || idx AS id, 'verified' AS class, 'numbering_gap' AS category, CASE idx % 3 WHEN 0 THEN 'minor' ELSE 'major' END AS severity, idx AS para_index FROM lines WHERE idx % 4 = 1),
 h AS (SELECT doc_id FROM labels WHERE quality = 0),
 a AS (SELECT doc_id, 'a-' || idx AS id, 'advisory' AS class, 'legal_risk' AS category, CASE idx % 2 WHEN 0 THEN 'critical' ELSE 'info' END AS severity, idx AS para_index FROM lines WHERE idx % 5 = 2 AND doc_id NOT IN (SELECT doc_id FROM h)),
 u AS (SELECT * FROM v UNION ALL SELECT * FROM a UNION ALL SELECT doc_id, '', 'advisory', 'meaning_change', 'info', NULL FROM h WHERE doc_id % 9 <> 0)
SELECT doc_id, id, class, category, severity, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END, coalesce(para_index, -1), id) AS BIGINT) AS place FROM u""")
def assemble_report(spark, d):
    """Lines as findings and advice; documents of low quality are those where a verdict finds nothing of substance, each ninth without a model."""
    p = lines(spark, d)
    found = lambda rows, kind, category, severity: rows.select("doc_id", F.concat(F.lit(kind[0] + "-"), F.col("idx").cast("string")).alias("id"), F.lit(kind).alias("class"), F.lit(category).alias("category"), severity.alias("severity"), F.lit("m").alias("message"), F.lit(0.5).alias("confidence"), F.col("idx").alias("para_index"), F.lit("").alias("node_id"))
    verified = found(p.where("idx % 4 = 1"), "verified", "numbering_gap", F.when(F.col("idx") % 3 == 0, "minor").otherwise("major"))
    advice = found(p.where("idx % 5 = 2"), "advisory", "legal_risk", F.when(F.col("idx") % 2 == 0, "critical").otherwise("info"))
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("substantive"), F.lit("r").alias("reason"), (F.col("doc_id") % 9 == 0).alias("no_model"))
    return longs(advisory.assemble(verified, advice, verdicts, ["doc_id"]), "place").select("doc_id", "id", "class", "category", "severity", "place")


@query("recommended_actions", "SELECT event_id, 'replacement' AS type FROM events WHERE event_type <> 'view' AND value >= 20")
def recommended_actions(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("old"), F.when(F.col("value") >= 20, F.col("event_id")).alias("paragraph_index"))
    return advisory.recommended_actions(e).select("event_id", "type")


@query("dedup_first", f"WITH {LINES_SQL} SELECT text, min(doc_id * 100000 + idx) AS first_at FROM lines GROUP BY text")
def dedup_first(spark, d):
    """The first occurrence of each line, by position and not by chance."""
    p = lines(spark, d).withColumn("first_at", F.col("doc_id") * 100000 + F.col("idx"))
    return report.first_by(p, ["text"], ["first_at"]).select("text", "first_at")


@query("token_jaccard", f"""
WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({aggressive_sql('text')}, ' '), lambda w: w <> '')) AS toks FROM conversations),
 p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.toks, b.toks)) AS shared, len(a.toks) + len(b.toks) AS total, len(a.toks) AS na, len(b.toks) AS nb FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN na > 0 AND nb > 0 THEN shared / (total - shared) ELSE 0 END, 6) AS score FROM p
""")
def token_jaccard(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("t"))
    after = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return s.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("score"))
