"""Queries of numbering checks, renumbering plans and parallel runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausegrid.operators import numbering, parallel, report

from .catalog import SEQ_SQL, longs, query, sequences, table

_CHECKS = f"""WITH {SEQ_SQL},
 c AS (SELECT *, count(*) OVER (PARTITION BY seq_key) AS n, lag(ordinal) OVER (PARTITION BY seq_key ORDER BY pos) AS before,
   min(pos) OVER (PARTITION BY seq_key, ordinal) AS holder, row_number() OVER (PARTITION BY seq_key, ordinal ORDER BY pos) AS times FROM seq)"""


def _of(spark, d, category):
    return numbering.findings(sequences(spark, d), ["seq_key"]).where(F.col("category") == category)


@query("numbering_duplicates", f"{_CHECKS} SELECT seq_key, pos, ordinal, holder FROM c WHERE n > 1 AND times > 1")
def numbering_duplicates(spark, d):
    return longs(_of(spark, d, numbering.DUPLICATE), "holder").select("seq_key", "pos", "ordinal", "holder")


@query("numbering_bad_start", f"{_CHECKS} SELECT seq_key, pos, ordinal FROM c WHERE n > 1 AND pos = 1 AND ordinal <> 1")
def numbering_bad_start(spark, d):
    return _of(spark, d, numbering.BAD_START).select("seq_key", "pos", "ordinal")


@query("numbering_out_of_order", f"{_CHECKS} SELECT seq_key, pos, ordinal, before FROM c WHERE n > 1 AND ordinal < before")
def numbering_out_of_order(spark, d):
    return _of(spark, d, numbering.OUT_OF_ORDER).select("seq_key", "pos", "ordinal", "before")


@query("numbering_gaps", f"{_CHECKS} SELECT seq_key, pos, before, ordinal, array_to_string(range(before + 1, ordinal), ', ') AS missing FROM c WHERE n > 1 AND ordinal > before + 1")
def numbering_gaps(spark, d):
    return _of(spark, d, numbering.GAP).select("seq_key", "pos", "before", "ordinal", "missing")


@query("numbering_mixed_forms", f"""
WITH s AS (SELECT l_orderkey AS seq_key, CASE l_returnflag WHEN 'A' THEN 'DOT' WHEN 'N' THEN 'PAREN' ELSE 'BRACKET' END AS form, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber AS pos FROM lineitem),
 f AS (SELECT seq_key, form, min(pos) AS first_pos, count(*) AS members FROM s GROUP BY seq_key, form)
SELECT seq_key, 'numbering_mixed_form' AS category, string_agg(form, ', ' ORDER BY first_pos, form) AS forms FROM f GROUP BY seq_key HAVING sum(members) > 1 AND count(*) > 1
""")
def numbering_mixed_forms(spark, d):
    form = F.when(F.col("l_returnflag") == "A", "DOT").when(F.col("l_returnflag") == "N", "PAREN").otherwise("BRACKET")
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq_key"), form.alias("form"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("pos"))
    return numbering.mixed_forms(s, ["seq_key"]).select("seq_key", "category", "forms")


_SUMMARY = f"""{_CHECKS},
 f AS (SELECT seq_key, 'major' AS severity FROM c WHERE n > 1 AND times > 1 UNION ALL SELECT seq_key, 'minor' FROM c WHERE n > 1 AND pos = 1 AND ordinal <> 1
   UNION ALL SELECT seq_key, 'major' FROM c WHERE n > 1 AND ordinal < before UNION ALL SELECT seq_key, 'major' FROM c WHERE n > 1 AND ordinal > before + 1),
 s AS (SELECT seq_key, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM f GROUP BY seq_key)"""


@query("numbering_summary", f"{_SUMMARY} SELECT seq_key, CAST(major + minor AS BIGINT) AS verified, CAST(critical AS BIGINT) AS critical, CAST(major AS BIGINT) AS major, CAST(minor AS BIGINT) AS minor, CAST(CASE WHEN critical > 0 THEN 2 WHEN major > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM s")
def numbering_summary(spark, d):
    f = numbering.findings(sequences(spark, d), ["seq_key"]).withColumn("class", F.lit("verified"))
    c = report.counters(f, ["seq_key"]).withColumn("exit_code", report.exit_code(F.col("critical"), F.col("major")).cast("long"))
    return c.select("seq_key", "verified", "critical", "major", "minor", "exit_code")


@query("decimal_prefix_mismatch", """
SELECT l_orderkey, l_partkey, l_suppkey, (l_suppkey % 7) || '.' || l_linenumber AS number, '' || (l_suppkey % 7) AS got, '' || (l_orderkey % 7) AS parent_number FROM lineitem WHERE l_suppkey % 7 <> l_orderkey % 7
""")
def decimal_prefix_mismatch(spark, d):
    part = lambda c: (F.col(c) % 7).cast("string")
    c = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.concat(part("l_suppkey"), F.lit("."), F.col("l_linenumber").cast("string")).alias("number"), part("l_orderkey").alias("parent_number"))
    return numbering.prefix_mismatches(c).select("l_orderkey", "l_partkey", "l_suppkey", "number", "got", "parent_number")


def _listed(spark, d):
    """Line numbers as bracketed letters, so that a plan has text to write."""
    return sequences(spark, d).withColumns({"kind": F.lit("LOWER"), "form": F.lit("PAREN")})


@query("renumber_plan", f"WITH {SEQ_SQL} SELECT seq_key, pos, chr(CAST(96 + ordinal AS INT)) || ')' AS old_text, chr(CAST(96 + pos AS INT)) || ')' AS new_text FROM seq WHERE ordinal <> pos")
def renumber_plan(spark, d):
    planned = numbering.plan(_listed(spark, d), ["seq_key"])
    return numbering.first_actions(planned, ["seq_key", "pos"], ["target"]).select("seq_key", "pos", "old_text", "new_text")


@query("renumber_verify", f"WITH {SEQ_SQL} SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(*) FILTER (ordinal <> pos) AS BIGINT) AS fixes, CAST(0 AS BIGINT) AS left_over FROM seq")
def renumber_verify(spark, d):
    planned = numbering.plan(_listed(spark, d), ["seq_key"])
    left = numbering.findings(numbering.apply_plan(planned).select("seq_key", "pos", "ordinal", "kind", "form"), ["seq_key"]).agg(F.count("*").alias("left_over"))
    return planned.agg(F.count("*").alias("members"), F.count("new_text").alias("fixes")).crossJoin(left)  # one row each


@query("renumber_summary", f"""
WITH {SEQ_SQL}, t AS (SELECT seq_key, count(*) FILTER (ordinal <> pos) AS fixes, list(chr(CAST(96 + ordinal AS INT)) || ')' ORDER BY pos) AS b, list(chr(CAST(96 + pos AS INT)) || ')' ORDER BY pos) AS a FROM seq GROUP BY seq_key)
SELECT seq_key, CAST(fixes AS BIGINT) AS fixes, array_to_string(b[1:12], ', ') || CASE WHEN len(b) > 12 THEN ', …' ELSE '' END AS before, array_to_string(a[1:12], ', ') || CASE WHEN len(a) > 12 THEN ', …' ELSE '' END AS after FROM t WHERE fixes > 0
""")
def renumber_summary(spark, d):
    return numbering.summary(numbering.plan(_listed(spark, d), ["seq_key"]), ["seq_key"])


# Turns of a conversation as headings: the role is the keyword, and the ordinal counts its turns, with slips.
_HEADS = "h AS (SELECT conv_id, role AS keyword, turn AS pos, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) + CASE WHEN turn % 7 = 3 THEN 1 ELSE 0 END AS ordinal FROM conversations)"
_RUNS = f"""WITH {_HEADS},
 r AS (SELECT conv_id, keyword, count(*) AS run_len, min(pos) AS first_pos FROM h GROUP BY conv_id, keyword HAVING count(*) >= 3),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_pos, keyword) AS run, min(run_len) OVER (PARTITION BY conv_id) AS shortest, count(*) OVER (PARTITION BY conv_id) AS n_runs FROM r),
 m AS (SELECT h.*, o.run, o.run_len, o.shortest, o.n_runs, lag(h.keyword) OVER (PARTITION BY h.conv_id ORDER BY h.pos) AS ahead, count(*) OVER (PARTITION BY h.conv_id) AS n FROM h JOIN o ON h.conv_id = o.conv_id AND h.keyword = o.keyword),
 s AS (SELECT *, sum(CASE WHEN ahead <> keyword THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS switches FROM m),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, keyword ORDER BY pos) AS place FROM s WHERE n_runs >= 2 AND n >= 6 AND switches >= 0.6 * (n - 1)),
 p AS (SELECT *, max(CASE WHEN run = 1 THEN ordinal END) OVER (PARTITION BY conv_id, place) AS base FROM k)"""


def _headings(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) + F.when(F.col("turn") % 7 == 3, 1).otherwise(0)
    return table(spark, d, "conversations").select("conv_id", F.col("role").alias("keyword"), F.col("turn").alias("pos"), n.alias("ordinal"))


@query("parallel_runs", f"{_RUNS} SELECT conv_id, keyword, CAST(run AS BIGINT) AS run, CAST(run_len AS BIGINT) AS run_len, CAST(shortest AS BIGINT) AS shortest, CAST(max(switches) AS BIGINT) AS switches FROM p GROUP BY conv_id, keyword, run, run_len, shortest")
def parallel_runs(spark, d):
    p = parallel.parallel_runs(_headings(spark, d), ["conv_id"])
    return longs(p.groupBy("conv_id", "keyword", "run", "run_len", "shortest").agg(F.max("switches").alias("switches")), "run", "run_len", "shortest", "switches")


@query("parallel_mismatch", f"""{_RUNS} SELECT conv_id, keyword, pos, CAST(place AS BIGINT) AS place, CAST(ordinal AS BIGINT) AS ordinal, CASE WHEN place > shortest THEN 'count' ELSE 'position' END AS problem
FROM p WHERE place > shortest OR (run > 1 AND ordinal <> base)""")
def parallel_mismatch(spark, d):
    return longs(parallel.mismatches(_headings(spark, d), ["conv_id"]), "place", "ordinal").select("conv_id", "keyword", "pos", "place", "ordinal", "problem")


@query("parallel_counts", f"""{_RUNS}, q AS (SELECT conv_id, run, keyword, count(*) AS n FROM p GROUP BY conv_id, run, keyword)
SELECT conv_id, string_agg('"' || keyword || '" punya ' || n, ' dan ' ORDER BY run) AS counts FROM q GROUP BY conv_id""")
def parallel_counts(spark, d):
    return parallel.describe(_headings(spark, d), ["conv_id"]).select("conv_id", "counts")
