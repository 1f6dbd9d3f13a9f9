"""Queries of the scalar layer over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.functions import numerals
from clausegrid.functions import text as T
from clausegrid.sources import files

from .catalog import LINES_SQL, lines, longs, query, table

# The normal forms in RE2's syntax and DuckDB's functions.
_SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FROM = "‘’‚′“”„″‐‑‒–—―−" + T.DROPPED
_TO = "''''''''" + '""""' + "-------"


def normal_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(translate({x}, '{_FROM}', '{_TO}'), '…', '...'), '{_SPACES}', ' ', 'g'))"


def bare_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"


def aggressive_sql(x: str) -> str:
    return bare_sql(f"lower({normal_sql(x)})")


# Lines with characters put in that normalisation folds or drops.
_DIRTY = "concat('“', text, '” – ‘x’…', chr(160), chr(8203), ' y  ')"


@query("scan_paragraphs", f"WITH {LINES_SQL} SELECT doc_id, idx, text, 'tabel ' || (idx + 1) || ' baris 1 kolom 2' AS place FROM lines")
def scan_paragraphs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    p = files.text_paragraphs(docs, ["doc_id"])
    return longs(p, "idx").select("doc_id", "idx", F.col("raw").alias("text"), T.table_label(F.col("idx") + 1, F.lit(1), F.lit(2)).alias("place"))


@query("ext_dispatch", r"""
SELECT page_id, lower(regexp_extract(path, '(\.[^./]*)$', 1)) AS suffix,
       CASE WHEN path LIKE '%.docx' THEN 'docx' WHEN path LIKE '%.pdf' THEN 'pdf'
            WHEN lower(regexp_extract(path, '(\.[^./]*)$', 1)) IN ('.txt', '.md', '.markdown', '') THEN 'text' ELSE 'unsupported' END AS format
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.docx' WHEN 2 THEN url || '.pdf' ELSE url || '.md' END AS path FROM pages) p
""")
def ext_dispatch(spark, d):
    url = F.col("url")
    path = F.when(F.col("page_id") % 4 == 0, url).when(F.col("page_id") % 4 == 1, F.concat(url, F.lit(".docx"))).when(F.col("page_id") % 4 == 2, F.concat(url, F.lit(".pdf"))).otherwise(F.concat(url, F.lit(".md")))
    return table(spark, d, "pages").select("page_id", files.suffix(path).alias("suffix"), files.file_format(path).alias("format"))


@query("normalize_text", f"WITH {LINES_SQL}, dirty AS (SELECT doc_id, idx, {_DIRTY} AS text FROM lines) SELECT doc_id, idx, {normal_sql('text')} AS normal FROM dirty")
def normalize_text(spark, d):
    return lines(spark, d).select("doc_id", "idx", T.normalize(F.expr(_DIRTY.replace("chr(160)", "char(160)").replace("chr(8203)", "'​'"))).alias("normal"))


@query("normalize_aggressive", f"WITH {LINES_SQL} SELECT doc_id, idx, {aggressive_sql('text')} AS normal FROM lines")
def normalize_aggressive(spark, d):
    return lines(spark, d).select("doc_id", "idx", T.normalize_aggressive(F.col("text")).alias("normal"))


@query("strip_punct", f"WITH {LINES_SQL} SELECT doc_id, idx, {bare_sql('text')} AS bare FROM lines")
def strip_punct(spark, d):
    return lines(spark, d).select("doc_id", "idx", T.strip_punctuation(F.col("text")).alias("bare"))


@query("cosmetic_pairs", f"""
WITH {LINES_SQL}, pairs AS (SELECT doc_id, idx, text AS a, CASE idx % 3 WHEN 0 THEN replace(text, ',', '') WHEN 1 THEN lower(text) ELSE '  ' || text || ' ' END AS b FROM lines)
SELECT doc_id, idx, a <> '' AND b <> '' AND {bare_sql('a')} = {bare_sql('b')} AS cosmetic, {normal_sql('a')} = {normal_sql('b')} AS same FROM pairs
""")
def cosmetic_pairs(spark, d):
    b = F.when(F.col("idx") % 3 == 0, F.replace("text", F.lit(","), F.lit(""))).when(F.col("idx") % 3 == 1, F.lower("text")).otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    p = lines(spark, d).withColumn("b", b)
    return p.select("doc_id", "idx", T.is_cosmetic(F.col("text"), F.col("b")).alias("cosmetic"), T.equal_ignoring_whitespace(F.col("text"), F.col("b")).alias("same"))


@query("tokenize_counts", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS BIGINT) AS words,
       CAST(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) + length(regexp_replace(text, '[\p{L}\p{Nd}]+', '', 'g')) AS BIGINT) AS tokens FROM documents
""")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").withColumn("t", T.tokens(F.col("text")))
    return t.select("doc_id", F.size(F.filter("t", lambda x: x.rlike(r"^[\p{L}\p{Nd}]"))).cast("long").alias("words"), F.size("t").cast("long").alias("tokens"))


@query("snippet_clip", r"""
WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\f\r\x{0B}]+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) > 48 THEN trim(substr(line, 1, 48)) || '…' ELSE line END AS snippet,
       CASE WHEN length(text) > 110 THEN substr(text, 1, 110) || '...' ELSE text END AS clipped FROM s
""")
def snippet_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.clip(F.col("text"), 110, "...").alias("clipped"))


@query("excerpt_window", """
WITH p AS (SELECT doc_id, text, strpos(text, '. ') - 1 AS s FROM documents WHERE strpos(text, '. ') > 0),
     w AS (SELECT doc_id, text, greatest(0, s - 60) AS low, least(length(text), s + 2 + 60) AS high FROM p)
SELECT doc_id, (CASE WHEN low > 0 THEN '...' ELSE '' END) || substr(text, CAST(low + 1 AS BIGINT), CAST(high - low AS BIGINT)) || (CASE WHEN high < length(text) THEN '...' ELSE '' END) AS excerpt FROM w
""")
def excerpt_window(spark, d):
    p = table(spark, d, "documents").withColumn("s", F.instr("text", ". ") - 1).where("s >= 0")
    return p.select("doc_id", T.excerpt(F.col("text"), F.col("s"), F.col("s") + 2).alias("excerpt"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


_TRIM = "' .,;:()[]\"'''"
_votes = lambda words: f"CAST(len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in words)}], x))) AS BIGINT)"


@query("language_votes", f"""
WITH t AS (SELECT doc_id, list_transform(string_split_regex(lower(text), '\\s+'), lambda x: trim(x, '.,;:()[]"''')) AS w FROM documents),
     v AS (SELECT doc_id, {_votes(T.INDONESIAN_WORDS)} AS id_votes, {_votes(T.ENGLISH_WORDS)} AS en_votes FROM t)
SELECT doc_id, id_votes, en_votes, CASE WHEN id_votes = 0 AND en_votes = 0 THEN '' WHEN id_votes >= en_votes THEN 'id' ELSE 'en' END AS guess FROM v
""")
def language_votes(spark, d):
    a, b = T.language_votes(F.col("text"))
    v = table(spark, d, "documents").select("doc_id", a.cast("long").alias("id_votes"), b.cast("long").alias("en_votes"))
    return v.withColumn("guess", T.language(F.col("id_votes"), F.col("en_votes")))


@query("title_case_lines", f"""
WITH {LINES_SQL}, u AS (SELECT doc_id, idx, CASE idx % 2 WHEN 0 THEN text ELSE upper(text) END AS text FROM lines),
     c AS (SELECT doc_id, idx, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers FROM u)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (letters >= 3 AND uppers * 100 // greatest(letters, 1) >= 80) AS BIGINT) AS captions FROM c GROUP BY doc_id
""")
def title_case_lines(spark, d):
    u = lines(spark, d).withColumn("text", F.when(F.col("idx") % 2 == 0, F.col("text")).otherwise(T.upper(F.col("text"))))
    return u.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_title_case(F.col("text"))).alias("captions"))


@query("full_text", f"WITH {LINES_SQL} SELECT doc_id, string_agg('[' || idx || ']' || text, chr(10) ORDER BY idx) AS full_text FROM lines GROUP BY doc_id")
def full_text(spark, d):
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("]"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n")
    return lines(spark, d).groupBy("doc_id").agg(joined.alias("full_text"))


ROMAN_SQL = "repeat('M', CAST({n} // 1000 AS INT)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][({n} // 100) % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][({n} // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][{n} % 10 + 1]"
ALPHA_SQL = "CASE WHEN {n} <= 26 THEN chr(CAST(96 + {n} AS INT)) WHEN {n} <= 702 THEN chr(CAST(97 + ({n} - 27) // 26 AS INT)) || chr(CAST(97 + ({n} - 1) % 26 AS INT)) ELSE chr(CAST(97 + ({n} - 703) // 676 AS INT)) || chr(CAST(97 + (({n} - 27) // 26) % 26 AS INT)) || chr(CAST(97 + ({n} - 1) % 26 AS INT)) END"


@query("roman_alpha_render", f"""
WITH p AS (SELECT p_partkey, CAST(p_partkey % 3999 + 1 AS BIGINT) AS n FROM part),
     r AS (SELECT p_partkey, n, {ROMAN_SQL.format(n='n')} AS roman, {ALPHA_SQL.format(n='n')} AS alpha FROM p)
SELECT p_partkey, roman, alpha, n AS roman_back, n AS alpha_back, '(' || lower(roman) || ')' AS bracketed, upper(alpha) || '.' AS dotted FROM r
""")
def roman_alpha_render(spark, d):
    n = F.col("n")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).alias("n"))
    p = p.withColumns({"roman": numerals.roman(n), "alpha": numerals.alpha(n)})
    return p.select("p_partkey", "roman", "alpha", numerals.parse_roman(F.lower("roman")).cast("long").alias("roman_back"), numerals.parse_alpha(F.col("alpha")).cast("long").alias("alpha_back"), numerals.render(F.lit("L_ROM"), F.lit("BRACKET"), n).alias("bracketed"), numerals.render(F.lit("UPPER"), F.lit("DOT"), n).alias("dotted"))


@query("article_numbers", f"""
WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS s FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN s END AS value FROM p
""")
def article_numbers(spark, d):
    s = F.col("p_size")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, s.cast("string")).when(k == 1, F.concat(F.lit("7."), s.cast("string"))).when(k == 2, numerals.roman(s)).otherwise("xyzzy")
    return table(spark, d, "part").select("p_partkey", numerals.article_number(text).cast("long").alias("value"))


_SEVERITY = "CASE l_linenumber % 6 WHEN 0 THEN 'Kritis' WHEN 1 THEN ' MAYOR ' WHEN 2 THEN 'info' WHEN 3 THEN 'critical' WHEN 4 THEN 'whatever' ELSE 'major' END"


@query("severity_norm", f"""
WITH s AS (SELECT lower(trim({_SEVERITY})) AS s, l_discount FROM lineitem),
     n AS (SELECT CASE WHEN s IN ('critical', 'kritis') THEN 'critical' WHEN s IN ('major', 'mayor') THEN 'major' WHEN s = 'info' THEN 'info' ELSE 'minor' END AS severity, greatest(0.0, least(1.0, l_discount * 20 - 0.5)) AS confidence FROM s)
SELECT severity, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS BIGINT) AS rank, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 4) AS confidence FROM n GROUP BY severity
""")
def severity_norm(spark, d):
    s = table(spark, d, "lineitem").select(T.normalize_severity(F.expr(_SEVERITY)).alias("severity"), T.clamp01(F.col("l_discount") * 20 - 0.5).alias("confidence"))
    out = s.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return out.select("severity", T.severity_rank(F.col("severity")).cast("long").alias("rank"), "n", "confidence")


_NODE_ID = "CASE o_orderkey % 5 WHEN 0 THEN 'pasal:' || o_custkey || '/ayat:2' WHEN 1 THEN 'root/huruf:a' WHEN 2 THEN 'bab:IV' WHEN 3 THEN 'root/article:' || o_custkey || '/clause:1' ELSE 'clause:' || o_custkey END"


@query("article_of", f"""
WITH o AS (SELECT o_orderkey, string_split({_NODE_ID}, '/') AS p FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(p[1], '^(pasal|article|clause):') THEN p[1] ELSE coalesce(list_filter(p, lambda x: regexp_matches(x, '^(pasal|article):'))[1], '') END AS article FROM o
""")
def article_of(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.article_of(F.expr(_NODE_ID)).alias("article"))


@query("heading_renumber", """
WITH h AS (SELECT p_partkey, p_size AS a, (p_partkey % 50) AS b, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN a <> b THEN 'Penomoran diubah: Pasal ' || a || ' → Pasal ' || b ELSE 'Teks diubah' END WHEN 1 THEN 'Teks diubah pada Pasal 1' ELSE 'Teks dihapus pada Pasal 1: "hari ' || a || '"' END AS title FROM h
""")
def heading_renumber(spark, d):
    a, b, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string"), F.col("p_partkey") % 3
    word = F.when(k == 0, "Pasal ").otherwise("hari ")
    prev, curr = F.concat(word, a), F.when(k == 2, "").otherwise(F.concat(word, b))
    context = F.when(k == 0, "").otherwise("Pasal 1")
    return table(spark, d, "part").select("p_partkey", T.change_title(F.lit("modified"), F.lit(False), prev, curr, context).alias("title"))


@query("json_salvage", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{"x": ' ELSE '' END || '{"k": ' || json_extract_string(props, '$.k') || '}' || CASE WHEN event_id % 3 = 2 THEN '}' ELSE '' END AS json FROM events
""")
def json_salvage(spark, d):
    """A model's answers with prose or fences around the JSON (events.props)."""
    import pandas as pd

    from clausegrid.operators import advisory

    fence = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, fence).otherwise(F.concat(F.lit("So {"), F.lit('"x": '), "props", F.lit("} done")))
    rows = table(spark, d, "events").select("event_id", text.alias("text"))

    def salvaged(frames):
        import json

        for frame in frames:
            yield pd.DataFrame({"event_id": frame.event_id, "json": [json.dumps(advisory.salvage_json(t), sort_keys=True) for t in frame.text]})

    return rows.mapInPandas(salvaged, "event_id bigint, json string")
