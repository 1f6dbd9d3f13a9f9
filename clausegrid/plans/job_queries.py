"""Queries of usage, jobs, traces and their streams, over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegrid.operators import jobs, usage

from .catalog import longs, query, table

_CALLS = "c AS (SELECT event_type AS node, CAST(round(value * 100) AS BIGINT) AS input, CAST(event_id % 700 AS BIGINT) AS read, CAST(event_id % 90 AS BIGINT) AS write, CAST(user_id AS BIGINT) AS output FROM events)"


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("node"), F.round(F.col("value") * 100).cast("long").alias("input"), (F.col("event_id") % 700).alias("read"), (F.col("event_id") % 90).alias("write"), F.col("user_id").alias("output"))


@query("usage_rollup", f"""
WITH {_CALLS} SELECT coalesce(node, 'total') AS node, CAST(count(*) AS BIGINT) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(read) AS BIGINT) AS read, CAST(sum(write) AS BIGINT) AS write, CAST(sum(output) AS BIGINT) AS output FROM c GROUP BY ROLLUP (node)
""")
def usage_rollup(spark, d):
    return usage.rollup(_calls(spark, d), ["input", "read", "write", "output"])


_TIER = "CASE node WHEN 'view' THEN 'triage' WHEN 'click' THEN 'analyze' WHEN 'error' THEN 'recommend' ELSE 'adjudicate' END"


@query("usage_cost", f"""
WITH {_CALLS}, f AS (SELECT node, read, write, output, CASE WHEN input - read - write < 0 THEN input ELSE input - read - write END AS fresh, CASE node WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 ELSE 5.0 END AS rate, CASE node WHEN 'view' THEN 5.0 WHEN 'click' THEN 15.0 ELSE 25.0 END AS rate_out FROM c)
SELECT node, CAST(sum(fresh) AS BIGINT) AS fresh, round(CAST(sum((fresh * rate + read * rate * 0.1 + write * rate * 1.25 + output * rate_out) / 1000000) AS DOUBLE), 4) AS usd FROM f GROUP BY node
""")
def usage_cost(spark, d):
    c = _calls(spark, d).withColumns({"tier": F.expr(_TIER), "fresh": usage.uncached(F.col("input"), F.col("read"), F.col("write"))})
    priced = c.join(F.broadcast(usage.rates(spark)), "tier")  # a row a tier
    return priced.groupBy("node").agg(F.sum("fresh").alias("fresh"), F.round(F.sum(usage.cost(*(F.col(k) for k in ("fresh", "read", "write", "output")))), 4).alias("usd"))


@query("rates_config", "SELECT * FROM (VALUES ('triage', 1.0::DOUBLE, 5.0::DOUBLE), ('analyze', 2.5::DOUBLE, 12.0::DOUBLE), ('recommend', 5.0::DOUBLE, 25.0::DOUBLE), ('adjudicate', 5.0::DOUBLE, 25.0::DOUBLE)) t(tier, rate_in, rate_out)")
def rates_config(spark, d):
    return usage.rates(spark, {"analyze": (2.5, 12.0)}).select("tier", "rate_in", "rate_out")


# Events as a trace: users are jobs, types are steps, and errors are notes.
_TRACE = "t AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'note' WHEN 'view' THEN 'thought' ELSE 'tool_call' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN 'triage' ELSE 'analyze' END AS node, event_type AS text FROM events)"


def _trace(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "note").when(F.col("event_type") == "view", "thought").otherwise("tool_call")
    node = F.when(F.col("event_type").isin("view", "click"), "triage").otherwise("analyze")
    return e.select("user_id", "event_id", kind.alias("kind"), node.alias("node"), F.col("event_type").alias("text"))


_COALESCED = f"""WITH {_TRACE}, n AS (SELECT *, CASE WHEN lag(node) OVER w = node AND lag(kind) OVER w = kind AND kind <> 'note' THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM n)"""


@query("trace_coalesce", f"{_COALESCED} SELECT user_id, CAST(seq AS BIGINT) AS seq, node, kind, string_agg(text, '' ORDER BY event_id) AS text, CAST(count(*) AS BIGINT) AS chunks FROM s GROUP BY user_id, seq, node, kind")
def trace_coalesce(spark, d):
    return longs(jobs.coalesce_stream(_trace(spark, d), "user_id", "event_id"), "seq")


@query("trace_next_seq", f"{_COALESCED} SELECT user_id, CAST(max(seq) + 1 AS BIGINT) AS next_seq FROM s GROUP BY user_id")
def trace_next_seq(spark, d):
    t = jobs.coalesce_stream(_trace(spark, d), "user_id", "event_id")
    return t.groupBy("user_id").agg((F.max("seq") + 1).cast("long").alias("next_seq"))


@query("trace_scan", "SELECT event_id AS seq, event_type AS node, ts AS at FROM events WHERE user_id = 7 ORDER BY event_id")
def trace_scan(spark, d):
    return table(spark, d, "events").where("user_id = 7").select(F.col("event_id").alias("seq"), F.col("event_type").alias("node"), F.col("ts").alias("at")).orderBy("seq")


@query("trace_by_node", f"{_COALESCED}, e AS (SELECT user_id, seq, node, string_agg(text, '' ORDER BY event_id) AS text FROM s GROUP BY user_id, seq, node) SELECT user_id AS job_id, CAST(CASE node WHEN 'triage' THEN 3 ELSE 4 END AS BIGINT) AS place, node, CAST(count(*) AS BIGINT) AS entries, string_agg(text, chr(10) ORDER BY seq) AS texts FROM e GROUP BY user_id, node")
def trace_by_node(spark, d):
    t = jobs.coalesce_stream(_trace(spark, d), "user_id", "event_id").withColumnRenamed("user_id", "job_id")
    return longs(jobs.trace_by_node(t), "place")


@query("trace_upsert", "SELECT user_id, event_id % 20 AS seq, arg_max(event_type, event_id) AS text, arg_min(event_type, event_id) AS node, min(ts) AS at FROM events GROUP BY ALL")
def trace_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 20).alias("seq"), F.col("event_type").alias("text"), F.col("event_type").alias("node"), F.lit("note").alias("kind"), F.col("ts").alias("at"), "event_id")
    return jobs.merge_trace(e, ["user_id", "seq"], "event_id").select("user_id", "seq", "text", "node", "at")


@query("job_upsert", "SELECT user_id AS job_id, event_type AS status, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def job_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    return jobs.latest(e, ["job_id"], "version")


_STEP = "['ingest_prev', 'ingest_curr', 'deterministic', 'triage', 'analyze', 'recommend', 'assemble'][CAST(event_id % 7 AS INT) + 1]"
_PROGRESS = f"p AS (SELECT user_id AS job_id, {_STEP} AS node, arg_max(CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END, event_id) AS status FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY ALL)"


def _progress(spark, d):
    steps = F.array(*map(F.lit, jobs.STEPS))
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error")
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.get(steps, (F.col("event_id") % 7).cast("int")).alias("node"), event.alias("event"), "event_id")
    return jobs.progress(e, ["job_id", "node"], "event_id")


@query("progress_steps", f"WITH {_PROGRESS} SELECT job_id, node, status FROM p")
def progress_steps(spark, d):
    return _progress(spark, d)


_STEPS = "s AS (SELECT job_id, k - 1 AS place, ['ingest_prev', 'ingest_curr', 'deterministic', 'triage', 'analyze', 'recommend', 'assemble'][k] AS node, use_ai FROM (SELECT DISTINCT user_id AS job_id, user_id % 2 = 0 AS use_ai FROM events) j, range(1, 8) r(k))"


@query("initial_steps", f"WITH {_STEPS} SELECT job_id, CAST(place AS BIGINT) AS place, node, CASE WHEN NOT use_ai AND node IN ('triage', 'analyze', 'recommend') THEN 'skipped' ELSE 'pending' END AS status FROM s")
def initial_steps(spark, d):
    j = table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.col("user_id") % 2 == 0).alias("use_ai")).distinct()
    return longs(jobs.initial_steps(j), "place")


@query("job_snapshot", f"""
WITH {_STEPS}, {_PROGRESS}, m AS (SELECT s.job_id, place, s.node, coalesce(p.status, CASE WHEN NOT use_ai AND s.node IN ('triage', 'analyze', 'recommend') THEN 'skipped' ELSE 'pending' END) AS status FROM s LEFT JOIN p ON p.job_id = s.job_id AND p.node = s.node),
 j AS (SELECT job_id, CASE WHEN bool_or(status = 'error') THEN 'failed' ELSE 'done' END AS job_status FROM m GROUP BY job_id)
SELECT m.job_id, CAST(place AS BIGINT) AS place, node, job_status, CASE WHEN status IN ('pending', 'running') THEN CASE job_status WHEN 'done' THEN 'skipped' ELSE 'error' END ELSE status END AS status FROM m JOIN j ON j.job_id = m.job_id
""")
def job_snapshot(spark, d):
    steps = initial_steps(spark, d).withColumnRenamed("status", "first").join(_progress(spark, d), ["job_id", "node"], "left").withColumn("status", F.coalesce("status", "first"))
    over = steps.groupBy("job_id").agg(F.when(F.bool_or(F.col("status") == "error"), "failed").otherwise("done").alias("job_status"))
    out = steps.join(over, "job_id")
    return out.select("job_id", "place", "node", "job_status", jobs.finish_steps(F.col("job_status"), F.col("status")).alias("status"))


@query("restore_interrupted", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'P' THEN 'failed' ELSE 'done' END AS status FROM orders")
def restore_interrupted(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), jobs.restore(status).alias("status"))


@query("job_recent", "SELECT o_orderkey AS job_id, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def job_recent(spark, d):
    """All jobs, the newest first."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created")).orderBy(F.desc("created"), "job_id")


@query("admission", "SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 64 AS admitted FROM orders WHERE o_orderstatus = 'O'")
def admission(spark, d):
    w = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), "o_orderdate")
    return jobs.admitted(w, ["o_orderdate", "job_id"]).select("job_id", "admitted")


@query("stream_job_state", f"WITH {_PROGRESS} SELECT job_id, node, status FROM p")
def stream_job_state(spark, d):
    """Step states kept by a stream over the event files: what ``progress_steps`` finds at once."""
    from clausegrid.streaming import jobs as streams

    return streams.run_over_files(spark, d)


@query("stream_trace", f"{_COALESCED} SELECT user_id AS job_id, CAST(seq AS BIGINT) AS seq, node, kind, string_agg(text, '' ORDER BY event_id) AS text FROM s GROUP BY user_id, seq, node, kind")
def stream_trace(spark, d):
    """Trace entries extended by a stream, one row for each entry as it last stood."""
    from clausegrid.streaming import trace as streams

    return streams.run_over_files(spark, d)
