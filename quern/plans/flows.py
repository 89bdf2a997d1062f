"""Ordered scans and event streams. Stateful ones have no SQL; the tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import sequences as Q, usage as U
from quern.plans.kit import Catalog
from quern.sources.standins import messages, read, usage_logs
from quern.streaming import coalesce as X

C = Catalog()
query, QUERIES, ORACLE_SQL = C.query, C.queries, C.sql


def events(spark, d):
    """Delta events of runs out of the event table: a run is a user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "text_delta"), ("click", "text_delta"), ("purchase", "thinking_delta"), ("signup", "tool_use_args_delta"), ("error", "control")) for x in pair]), F.col("event_type"))
    return read(spark, d, "events").select(
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_id"),
        kind.alias("type"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), F.concat(F.lit("x"), F.col("event_id"))).alias("text"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("t"), F.col("event_id") % 3)).alias("tool_call_id"),
        F.when(F.col("event_type") == "signup", F.col("props")).alias("args"),
        F.col("event_id").alias("arrival"),
    )


@query("SELECT session_id, id, dense_rank() OVER (PARTITION BY session_id ORDER BY g) AS segment FROM (SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY started_at, id) AS g FROM (SELECT session_id, id, started_at, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY session_id ORDER BY started_at, id) THEN 1 ELSE 0 END AS c FROM logs))", "logs")
def segments_by_kind(spark, d):
    return Q.segments(usage_logs(spark, d), ["session_id"], ["started_at", "id"], "event_type").select("session_id", "id", "segment")


@query("SELECT user_id, seq, expected, seq - expected AS missing FROM (SELECT user_id, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS expected FROM events) WHERE seq > expected + 300 OR seq > expected")
def sequence_gaps(spark, d):
    return Q.gaps(read(spark, d, "events").select("user_id", F.col("event_id").alias("seq")), ["user_id"], "seq")


@query("""SELECT id, CASE WHEN sort_order > 5 THEN -1000000000 + row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1
 ELSE (sort_order // 2) * 1000 + CASE role WHEN 'assistant' THEN 100 WHEN 'system' THEN 200 ELSE 0 END + least(row_number() OVER (PARTITION BY session_id, CASE WHEN sort_order > 5 THEN NULL ELSE sort_order // 2 END, role ORDER BY created_at, id) - 1, 99) END AS seq FROM messages""", "messages")
def message_part_order(spark, d):
    rows = messages(spark, d).withColumn("iteration", F.when(F.col("sort_order") <= 5, F.floor(F.col("sort_order") / 2)))
    return Q.part_sequence(rows, ["session_id"], ["created_at", "id"], "iteration", "role", ("user", "assistant", "system")).select("id", "seq")


@query("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at) AS a, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS b FROM messages) WHERE a <= 1 OR b <= 2", "messages")
def head_and_tail(spark, d):
    return Q.head_and_tail(messages(spark, d), ["session_id"], ["created_at"], 1, 2).select("id")


@query("SELECT id FROM (SELECT id, sum(length(content)) OVER w AS s, row_number() OVER w AS n FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at DESC ROWS UNBOUNDED PRECEDING)) WHERE s <= 800 OR n <= 2", "messages")
def token_budget_tail(spark, d):
    return Q.budget_tail(messages(spark, d).withColumn("cost", F.length("content")), ["session_id"], ["created_at"], "cost", 800).select("id")


@query()
def token_budget_tail_realigned(spark, d):
    rows = messages(spark, d).select("id", "session_id", "created_at", F.length("content").alias("cost"), F.when(F.col("role") == "assistant", "tool_result").when(F.col("meta").isNotNull(), "summary").otherwise("user").alias("kind"))
    return Q.realigned_tail(rows, "session_id", "created_at", "cost", "kind", 800).select("id")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part")
def interleaved_brands(spark, d):
    return Q.interleave(read(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey", F.col("turn").cast("long").alias("turn"))


@query()
def todo_last_batches(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.unix_date(F.to_date("o_orderdate")).alias("created_at"), (F.unix_date(F.to_date("o_orderdate")) + F.col("o_orderkey") % 90).alias("updated_at"))
    return Q.todo_batches(rows).select("session_id", "id")


@query()
def alerts_emitted(spark, d):
    return Q.emitted_alerts(usage_logs(spark, d).where("status = 'error'").select("user_id", "id", "started_at"), "user_id", "started_at", 3 * U.DAY)


@query()
def requests_rate_limited(spark, d):
    return Q.rate_limited(usage_logs(spark, d).select("user_id", "id", "started_at"), "user_id", "started_at", 5, 2 * U.DAY)


@query("""SELECT session_id, p.b AS boundary, coalesce(p.s, lone) AS summary FROM (SELECT session_id, arg_max(id, created_at) AS lone FROM messages WHERE role = 'assistant' GROUP BY 1) LEFT JOIN (
 SELECT session_id, arg_max(b, at_) AS b, arg_max(s, at_) AS s FROM (SELECT session_id, g, max(CASE WHEN sort_order % 3 = 2 THEN created_at END) AS at_, max(CASE WHEN sort_order % 3 = 2 THEN id END) AS b, arg_min(id, created_at) FILTER (role = 'assistant') AS s
 FROM (SELECT *, sum(CASE WHEN sort_order % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at) AS g FROM messages) WHERE role = 'assistant' OR sort_order % 3 = 2 GROUP BY 1, 2) WHERE b IS NOT NULL AND s IS NOT NULL GROUP BY 1) p USING (session_id)""", "messages")
def boundary_and_summary(spark, d):
    rows = messages(spark, d)
    return Q.last_pair(rows, ["session_id"], ["created_at"], F.col("sort_order") % 3 == 2, F.col("role") == "assistant", "created_at", "id")


@query()
def coalesced_events(spark, d):
    return X.replay(events(spark, d), size=40)


@query()
def coalesced_event_stream(spark, d):
    """The event table through the stateful coalescer of the stream. Each run's log is closed by a loop_end, so nothing is left to a timer and the result is that of the replay of the same log."""
    return X.coalesce_stream(closed_events(spark, d), size=40, flush_ms=3_600_000)


def closed_events(spark, d):
    """The delta events, and a loop_end after the last of each run."""
    rows = events(spark, d)
    ends = rows.groupBy("run_id").agg((F.max("arrival") + 1).alias("arrival"))
    return rows.unionByName(ends.withColumn("type", F.lit("loop_end")), allowMissingColumns=True)


@query("""SELECT run_id, iteration, kind, content, completed FROM (SELECT *, coalesce(kind = 'thinking' AND max(CASE WHEN kind <> 'thinking' THEN last_ END) OVER (PARTITION BY run_id, iteration) > last_, false) AS completed FROM (
 SELECT user_id AS run_id, event_id // 1000 AS iteration, CASE event_type WHEN 'purchase' THEN 'thinking' ELSE 'text' END AS kind, max(event_id) AS last_, string_agg('x' || event_id, '' ORDER BY event_id) AS content FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY 1, 2, 3))""")
def stream_slots(spark, d):
    rows = read(spark, d, "events").where("event_type IN ('purchase', 'view', 'click')")
    deltas = rows.select(F.col("user_id").alias("run_id"), F.floor(F.col("event_id") / 1000).alias("iteration"), F.when(F.col("event_type") == "purchase", "thinking").otherwise("text").alias("kind"), F.concat(F.lit("x"), F.col("event_id")).alias("value"), F.col("event_id").alias("arrival"))
    return X.slots(deltas).select("run_id", "iteration", "kind", "content", "completed")


@query("SELECT event_id, 'x' || event_id AS delta FROM events WHERE event_id % 10 <> 0")
def sse_deltas(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, "data: [DONE]").otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"x'), F.col("event_id"), F.lit('"},"finish_reason":null}]}')))
    return X.sse_deltas(read(spark, d, "events").select("event_id", line.alias("line"))).select("event_id", "delta")


@query("SELECT run_id, first AS first, last AS last, added, op, open_ FROM (SELECT user_id AS run_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, count(*) FILTER (event_type = 'signup') AS added, arg_min(event_type, event_id) AS op, bool_or(event_type = 'error') AS open_ FROM events GROUP BY 1)")
def collapsed_changes(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.count_if(F.col("event_type") == "signup").alias("added"), F.min_by("event_type", "event_id").alias("op"), F.bool_or(F.col("event_type") == "error").alias("open_")
    )


@query("SELECT session_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, arg_max(cache_read_tokens, (started_at, id)) AS context, count(*) AS timings FROM logs GROUP BY 1", "logs")
def merged_usage(spark, d):
    last = F.struct("started_at", "id")
    return usage_logs(spark, d).groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max_by("cache_read_tokens", last).alias("context"), F.count("*").alias("timings"))


@query("SELECT date_trunc('month', o_orderdate) AS month, cell, count(*) AS n FROM (SELECT *, datediff('day', date_trunc('month', o_orderdate) - INTERVAL (dayofweek(date_trunc('month', o_orderdate))) DAY, o_orderdate) AS cell FROM orders) GROUP BY 1, 2")
def calendar_cells(spark, d):
    month = F.date_trunc("month", "o_orderdate")
    start = F.date_sub(month.cast("date"), (F.dayofweek(month) - 1).cast("int"))  # the Sunday at or before the first
    rows = read(spark, d, "orders").select(month.cast("timestamp_ntz").alias("month"), F.date_diff(F.col("o_orderdate").cast("date"), start).cast("long").alias("cell"))
    return rows.groupBy("month", "cell").agg(F.count("*").alias("n"))


# Extensions that the operational model itself doesn't have.


@query("SELECT event_type, user_id % 5 AS bucket, count(*) AS n, grouping(event_type)::INT AS g FROM events GROUP BY CUBE (event_type, user_id % 5)")
def extension_cube(spark, d):
    return read(spark, d, "events").cube("event_type", (F.col("user_id") % 5).alias("bucket")).agg(F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("g")).select("event_type", "bucket", "n", "g")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def extension_distinct_users(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def extension_except(spark, d):
    poor = read(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("key")).subtract(poor)


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extension_tumbling_windows(spark, d):
    rows = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return X.tumbling(rows, "at", "6 hours", "1 hour", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))
