"""Queries of markers, headings, citations and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegrid.functions import headings as H
from clausegrid.functions import markers as M
from clausegrid.functions import numerals
from clausegrid.functions import references as R
from clausegrid.operators import tree

from .catalog import LINES_SQL, SEQ_SQL, lines, longs, query, sequences, table
from .text_queries import ROMAN_SQL

# Markers as lists write them, from a line item's number; the lines of documents are the negative cases.
_MARK = """CASE l_suppkey % 8 WHEN 0 THEN '(' || l_linenumber || ') isi' WHEN 1 THEN chr(CAST(96 + l_linenumber AS INT)) || '. isi' WHEN 2 THEN '  ' || (l_partkey % 30) || '.' || l_linenumber || ' isi'
 WHEN 3 THEN l_linenumber || ') isi' WHEN 4 THEN lower(['I','II','III','IV','V','VI','VII'][l_linenumber]) || '.' WHEN 5 THEN '(' || upper(chr(CAST(96 + l_linenumber AS INT))) || ')' WHEN 6 THEN 'PT. ABC' ELSE l_linenumber || '.' || l_linenumber || '. isi' END"""


def _mark():
    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 8
    text, letter = n.cast("string"), F.char(n + 96)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (
        F.when(k == 0, say("(", text, ") isi")).when(k == 1, say(letter, ". isi")).when(k == 2, say("  ", (F.col("l_partkey") % 30).cast("string"), ".", text, " isi"))
        .when(k == 3, say(text, ") isi")).when(k == 4, say(F.lower(numerals.roman(n)), ".")).when(k == 5, say("(", F.upper(letter), ")")).when(k == 6, "PT. ABC").otherwise(say(text, ".", text, ". isi"))
    )


# One row for each canonical numeral.
_ROMANS = f"romans AS (SELECT n, {ROMAN_SQL.format(n='n')} AS roman FROM range(1, 4000) r(n))"


@query("parse_markers", f"""
WITH {_ROMANS}, {LINES_SQL},
 t AS (SELECT text FROM lines UNION ALL SELECT {_MARK} FROM lineitem),
 m AS (SELECT regexp_extract(text, '^[\\s\\p{{Zs}}]*\\(\\s*([0-9]{{1,3}}|[A-Za-z]{{1,4}})\\s*\\)', 1) AS b,
              regexp_extract(text, '^[\\s\\p{{Zs}}]*([0-9]{{1,3}}(?:\\.[0-9]{{1,3}})+)(\\.?)(\\s|$)', 1) AS d,
              regexp_extract(text, '^[\\s\\p{{Zs}}]*([0-9]{{1,3}}(?:\\.[0-9]{{1,3}})+)(\\.?)(\\s|$)', 2) AS dot,
              regexp_extract(text, '^[\\s\\p{{Zs}}]*([0-9]{{1,3}}|[A-Za-z]{{1,4}})\\s*([.)])(\\s|$)', 1) AS s,
              regexp_extract(text, '^[\\s\\p{{Zs}}]*([0-9]{{1,3}}|[A-Za-z]{{1,4}})\\s*([.)])(\\s|$)', 2) AS mark FROM t),
 f AS (SELECT *, CASE WHEN b <> '' THEN b WHEN d <> '' THEN d ELSE s END AS token, CASE WHEN b <> '' THEN 'BRACKET' WHEN d <> '' THEN CASE WHEN dot = '.' THEN 'DOT' ELSE 'BARE' END WHEN mark = '.' THEN 'DOT' ELSE 'PAREN' END AS form FROM m WHERE b <> '' OR d <> '' OR s <> ''),
 c AS (SELECT f.*, token = upper(token) AS up, token = upper(token) OR token = lower(token) AS uniform, r.n AS roman,
              CASE WHEN regexp_matches(token, '^[A-Za-z]$') THEN ascii(lower(token)) - 96 WHEN regexp_matches(token, '^[A-Za-z]{{2}}$') THEN (ascii(lower(token)) - 96) * 26 + ascii(lower(token)[2]) - 96 END AS alpha
       FROM f LEFT JOIN romans r ON r.roman = upper(f.token)),
 k AS (SELECT form, token, CASE WHEN b = '' AND d <> '' THEN 'DECIMAL' WHEN regexp_matches(token, '^[0-9]+$') THEN CASE WHEN TRY_CAST(token AS INT) > 0 THEN 'DIGIT' END
              WHEN NOT uniform THEN NULL WHEN roman IS NOT NULL THEN CASE WHEN up THEN 'U_ROM' ELSE 'L_ROM' END WHEN alpha IS NOT NULL THEN CASE WHEN up THEN 'UPPER' ELSE 'LOWER' END END AS kind,
              CASE WHEN b = '' AND d <> '' THEN TRY_CAST(regexp_extract(d, '([0-9]+)$', 1) AS BIGINT) WHEN regexp_matches(token, '^[0-9]+$') THEN TRY_CAST(token AS BIGINT) ELSE coalesce(roman, alpha) END AS ordinal,
              roman IS NOT NULL AND alpha IS NOT NULL AS ambiguous FROM c)
SELECT kind, form, CASE WHEN kind = 'DECIMAL' THEN 'clause' WHEN kind IN ('LOWER', 'UPPER') THEN 'huruf' WHEN kind IN ('L_ROM', 'U_ROM') THEN 'item' WHEN form = 'BRACKET' THEN 'ayat' ELSE 'angka' END AS node_kind,
       token, CAST(ordinal AS BIGINT) AS ordinal, ambiguous, CAST(count(*) AS BIGINT) AS n
FROM k WHERE kind IS NOT NULL GROUP BY ALL
""")
def parse_markers(spark, d):
    texts = lines(spark, d).select("text").unionByName(table(spark, d, "lineitem").select(_mark().alias("text")))
    m = texts.select(M.parse_marker(F.col("text")).alias("m")).where("m is not null").select("m.*")
    return m.groupBy("kind", "form", M.node_kind(F.col("kind"), F.col("form")).alias("node_kind"), "token", F.col("ordinal").cast("long").alias("ordinal"), "ambiguous").agg(F.count("*").alias("n"))


# Tokens of lists that may be read as letters or as numerals: c, d, i, l, m, v, x and pairs.
_TOKENS = "['a','b','c','d','i','v','x','ii','iv','cd']"


@query("resolve_marker_family", f"""
WITH {SEQ_SQL}, {_ROMANS},
 t AS (SELECT seq_key, pos, {_TOKENS}[(ordinal + seq_key) % 10 + 1] AS token FROM seq),
 m AS (SELECT t.*, r.n AS roman, CASE WHEN length(token) = 1 THEN ascii(token) - 96 ELSE (ascii(token) - 96) * 26 + ascii(token[2]) - 96 END AS alpha FROM t LEFT JOIN romans r ON r.roman = upper(t.token)),
 w AS (SELECT seq_key, list(alpha ORDER BY pos) AS alphas, list(coalesce(roman, alpha) ORDER BY pos) AS firsts, arg_min('LOWER', pos) FILTER (roman IS NULL) AS sure FROM m GROUP BY seq_key),
 s AS (SELECT seq_key, sure, list_reduce(list_prepend(0, alphas), lambda n, x: CASE WHEN x = n + 1 THEN n + 1 ELSE n END) AS as_alpha, list_reduce(list_prepend(0, firsts), lambda n, x: CASE WHEN x = n + 1 THEN n + 1 ELSE n END) AS as_roman FROM w)
SELECT seq_key, coalesce(sure, CASE WHEN as_alpha > as_roman THEN 'LOWER' ELSE 'L_ROM' END) AS kind FROM s
""")
def resolve_marker_family(spark, d):
    words = F.array(*map(F.lit, ["a", "b", "c", "d", "i", "v", "x", "ii", "iv", "cd"]))
    t = sequences(spark, d).withColumn("token", F.get(words, ((F.col("ordinal") + F.col("seq_key")) % 10).cast("int")))
    m = t.select("seq_key", "pos", M.classify(F.col("token")).alias("m"))
    lists = m.groupBy("seq_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("ms"))
    return lists.select("seq_key", M.resolve_family(F.col("ms")).alias("kind"))


_HEADING = "CASE p_partkey % 6 WHEN 0 THEN 'Pasal ' || p_size WHEN 1 THEN 'BAB ' || {r} WHEN 2 THEN '  ARTICLE ' || p_size || '.2 Scope' WHEN 3 THEN 'Paragraf ' || p_size || ':' WHEN 4 THEN 'Bagian Kedua Belas' ELSE 'dalam Pasal ' || p_size END"


@query("parse_headings", f"""
WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name, {ROMAN_SQL.format(n='CAST(p_size AS BIGINT)')} AS r FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pasal' WHEN 1 THEN 'bab' WHEN 2 THEN 'article' WHEN 3 THEN 'paragraf' WHEN 4 THEN 'bagian' END AS kind,
       CASE p_partkey % 6 WHEN 0 THEN '' || p_size WHEN 1 THEN r WHEN 2 THEN p_size || '.2' WHEN 3 THEN '' || p_size WHEN 4 THEN 'Kedua Belas' END AS number,
       CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN 2 WHEN 3 THEN p_size WHEN 4 THEN 12 END AS ordinal FROM p
""")
def parse_headings(spark, d):
    p = table(spark, d, "part").withColumn("r", numerals.roman(F.col("p_size")))
    p = p.select("p_partkey", H.parse_heading(F.expr(_HEADING.format(r="r"))).alias("h"))
    return longs(p.select("p_partkey", "h.kind", "h.number", "h.ordinal"), "ordinal")


@query("heading_lines", f"""
WITH {LINES_SQL} SELECT CAST(count(*) FILTER (regexp_matches(text, '(?i)^\\s*(?:BAB|Bagian|Paragraf|Pasal|Article|Clause|Section)\\s+([0-9]{{1,4}}(?:\\.[0-9]{{1,3}})*|[IVXLCDM]{{1,7}})\\b')) AS BIGINT) AS headings, CAST(count(*) AS BIGINT) AS n FROM lines
""")
def heading_lines(spark, d):
    return lines(spark, d).agg(F.count(H.parse_heading(F.col("text"))).alias("headings"), F.count("*").alias("n"))


@query("learn_headings", """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
 o AS (SELECT user_id, event_id, event_type AS word, CASE WHEN event_type = 'error' THEN 1 + k % 3 ELSE k END AS ordinal FROM r),
 l AS (SELECT *, lag(ordinal) OVER (PARTITION BY user_id, word ORDER BY event_id) AS before FROM o)
SELECT user_id, word, CAST(count(*) AS BIGINT) AS hits, round(avg(CASE WHEN before IS NULL THEN NULL WHEN ordinal > before THEN 1.0 ELSE 0.0 END), 4) AS ascending
FROM l GROUP BY user_id, word HAVING count(*) >= 3 AND avg(CASE WHEN before IS NULL THEN NULL WHEN ordinal > before THEN 1.0 ELSE 0.0 END) >= 0.7
""")
def learn_headings(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    e = table(spark, d, "events").withColumn("k", k)
    n = F.when(F.col("event_type") == "error", 1 + F.col("k") % 3).otherwise(F.col("k"))
    p = e.select("user_id", "event_id", F.concat("event_type", F.lit(" "), n.cast("string"), F.lit(".")).alias("text"))
    found = H.learned_vocabulary(p, ["user_id"], "event_id", "text")
    return found.select("user_id", "word", "hits", F.round("ascending", 4).alias("ascending"))


_CITING = "CASE l_suppkey % 4 WHEN 0 THEN 'sebagaimana dimaksud dalam Pasal ' || (l_partkey % 50) || ' ayat (' || l_linenumber || ') huruf B dan Pasal ' || l_suppkey WHEN 1 THEN 'see Section ' || (l_partkey % 50) || '(a) and clause 7 no. 2' WHEN 2 THEN 'ayat (3) huruf c' ELSE 'Pasal ini' END"
_IDS = """SELECT * FROM (
 SELECT l_suppkey % 4 AS k, 'id' AS lang, '' || (l_partkey % 50) AS pasal, '' || l_linenumber AS ayat, 'b' AS huruf, '' AS angka FROM lineitem
 UNION ALL SELECT l_suppkey % 4, 'id', '' || l_suppkey, '', '', '' FROM lineitem WHERE l_suppkey % 4 = 0) WHERE k = 0
 UNION ALL SELECT k, 'en', p, '', 'a', '' FROM (SELECT l_suppkey % 4 AS k, '' || (l_partkey % 50) AS p FROM lineitem) WHERE k = 1
 UNION ALL SELECT k, 'en', '7', '', '', '2' FROM (SELECT l_suppkey % 4 AS k FROM lineitem) WHERE k = 1
 UNION ALL SELECT k, 'id', 'i', '', '', '' FROM (SELECT l_suppkey % 4 AS k FROM lineitem) WHERE k = 3"""


def _cited(spark, d):
    refs = table(spark, d, "lineitem").select(F.explode(R.absolute(F.expr(_CITING))).alias("r"))
    return refs.select("r.lang", "r.pasal", "r.ayat", "r.huruf", "r.angka")


@query("extract_refs", f"WITH i AS ({_IDS}) SELECT lang, pasal, ayat, huruf, angka, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL")
def extract_refs(spark, d):
    return _cited(spark, d).groupBy("lang", "pasal", "ayat", "huruf", "angka").agg(F.count("*").alias("n"))


@query("ref_target_ids", f"""
WITH i AS ({_IDS}) SELECT CASE lang WHEN 'en' THEN 'article:' ELSE 'pasal:' END || pasal || CASE WHEN ayat <> '' THEN '/ayat:' || ayat ELSE '' END || CASE WHEN huruf <> '' THEN '/huruf:' || huruf ELSE '' END || CASE WHEN angka <> '' THEN '/angka:' || angka ELSE '' END AS target_id, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL
""")
def ref_target_ids(spark, d):
    r = _cited(spark, d)
    return r.groupBy(R.target_id(*(F.col(c) for c in r.columns)).alias("target_id")).agg(F.count("*").alias("n"))


@query("ref_citations", f"""
WITH i AS ({_IDS}) SELECT CASE lang WHEN 'en' THEN 'Article ' ELSE 'Pasal ' END || pasal || CASE WHEN ayat <> '' THEN ' ayat (' || ayat || ')' ELSE '' END || CASE WHEN huruf <> '' THEN ' huruf ' || huruf ELSE '' END || CASE WHEN angka <> '' THEN ' angka ' || angka ELSE '' END AS citation, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL
""")
def ref_citations(spark, d):
    r = _cited(spark, d)
    return r.groupBy(R.citation(*(F.col(c) for c in r.columns)).alias("citation")).agg(F.count("*").alias("n"))


@query("find_references_to", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'pasal:' || (l_partkey % 50) || '/ayat:' || l_linenumber || '/huruf:b' AS target_id, length('sebagaimana dimaksud dalam ') AS start FROM lineitem WHERE l_suppkey % 4 = 0 AND l_partkey % 50 = 7
""")
def find_references_to(spark, d):
    """Paragraphs that cite one article, with where in the text they do."""
    import pandas as pd

    p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.expr(_CITING).alias("text")).where(F.col("text").rlike(r"Pasal 7 ayat"))

    def found(frames):
        for frame in frames:
            rows = [(*row[:4], r["start"], r["lang"], r["pasal"], r["ayat"], r["huruf"], r["angka"]) for row in frame.itertuples(index=False) for r in R.extract(row.text)]
            yield pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "start", "lang", "pasal", "ayat", "huruf", "angka"])

    refs = p.mapInPandas(found, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, start bigint, lang string, pasal string, ayat string, huruf string, angka string")
    refs = refs.withColumn("target_id", R.target_id(*(F.col(c) for c in ("lang", "pasal", "ayat", "huruf", "angka"))))
    return refs.where("pasal = '7' and ayat <> ''").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "target_id", "start")


@query("owner_asof", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM events
""")
def owner_asof(spark, d):
    """The last heading (a signup) at or before each paragraph (an event) of a document (a user)."""
    e = table(spark, d, "events").select(F.col("user_id"), F.col("event_id").alias("idx"), "event_type")
    heads = e.where("event_type = 'signup'").select("user_id", F.col("idx").alias("head_index"), F.col("idx").cast("string").alias("node_id"), *(F.lit("").alias(c) for c in ("path", "article_id", "article_number", "article_kind")))
    return tree.owners(e, heads, ["user_id"]).select(F.col("idx").alias("event_id"), F.col("node_id").cast("long").alias("owner"))


@query("close_ranges", """
WITH h AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS level FROM events WHERE event_type IN ('signup', 'purchase', 'click')),
 n AS (SELECT *, min(CASE WHEN level <= 1 THEN event_id END) OVER w AS n1, min(CASE WHEN level <= 2 THEN event_id END) OVER w AS n2, min(event_id) OVER w AS n3 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 l AS (SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id)
SELECT event_id, CAST(level AS BIGINT) AS level, coalesce(CASE level WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END - 1, last_id) AS end_id FROM n JOIN l USING (user_id)
""")
def close_ranges(spark, d):
    """Where each heading's range ends: before the next one of its level or above, else at the document's end."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    h = e.where(F.col("event_type").isin("signup", "purchase", "click")).select("user_id", "event_id", level.cast("long").alias("level"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    after = [F.min(F.when(F.col("level") <= k, F.col("event_id"))).over(w).alias(f"n{k}") for k in (1, 2, 3)]
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    end = F.when(F.col("level") == 1, F.col("n1")).when(F.col("level") == 2, F.col("n2")).otherwise(F.col("n3")) - 1
    return h.select("*", *after).join(last, "user_id").select("event_id", "level", F.coalesce(end, F.col("last_id")).alias("end_id"))


@query("article_counts", "SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus IN ('O', 'P')) AS BIGINT) AS articles, CAST(count(*) AS BIGINT) AS nodes FROM orders GROUP BY o_custkey")
def article_counts(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "pasal").when(F.col("o_orderstatus") == "P", "article").otherwise("ayat")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(kind.isin(*tree.ARTICLES)).alias("articles"), F.count("*").alias("nodes"))


@query("neighbourhood", """
SELECT a.doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(b.text)) AS BIGINT) AS chars FROM (WITH """ + LINES_SQL + """ SELECT * FROM lines) a
JOIN (WITH """ + LINES_SQL + """ SELECT * FROM lines) b ON a.doc_id = b.doc_id AND b.idx BETWEEN a.idx - 2 AND a.idx + 2 WHERE starts_with(a.text, 'The ') GROUP BY a.doc_id
""")
def neighbourhood(spark, d):
    """Paragraphs within two of one that begins with ``The``: a range join on position, met by exploding the range."""
    p = lines(spark, d)
    near = p.where(F.col("text").startswith("The ")).select("doc_id", F.explode(F.sequence(F.col("idx") - 2, F.col("idx") + 2)).alias("idx"))
    return near.join(p, ["doc_id", "idx"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("section_tree", """
SELECT r_regionkey || '' AS region, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS children, CAST(count(c_custkey) AS BIGINT) AS grandchildren
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey
""")
def section_tree(spark, d):
    """Nodes to depth two below each root: ids are paths, and depth is their number of segments."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    ids = table(spark, d, "region").select(F.array(F.col("r_regionkey").cast("string")).alias("path"))
    ids = ids.unionByName(nation.select(F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("path")))
    ids = ids.unionByName(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(*(F.col(c).cast("string") for c in ("n_regionkey", "n_nationkey", "c_custkey"))).alias("path")))
    return ids.groupBy(F.col("path")[0].alias("region")).agg(F.count_if(F.size("path") == 2).alias("children"), F.count_if(F.size("path") == 3).alias("grandchildren"))


@query("build_tree")
def build_tree(spark, d):
    """Trees over line items written as lists under their orders' headings; a stack per document has no SQL form."""
    seq = sequences(spark, d)
    text = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("("), F.col("ordinal").cast("string"), F.lit(") isi"))).otherwise(F.concat(F.char(F.col("ordinal").cast("int") + 96), F.lit(". isi")))
    heads = seq.select("seq_key").distinct().select("seq_key", F.lit(0).alias("idx"), F.concat(F.lit("Pasal "), (F.col("seq_key") % 90 + 1).cast("string")).alias("text"))
    p = heads.unionByName(seq.select("seq_key", F.col("pos").cast("int").alias("idx"), text.alias("text")))
    return tree.build(p, ["seq_key"]).select("seq_key", "node_id", "parent_id", "preorder", "kind", "ordinal", "level", "start", "end")
