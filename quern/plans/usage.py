"""Usage queries over the request-log view, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import paging, usage as U
from quern.sources.standins import USAGE_SQL, usage_logs

START, END = 1_704_067_200_000 + 3 * U.DAY, 1_704_067_200_000 + 9 * U.DAY
OFFSET = 330
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {USAGE_SQL}{sql if sql.lstrip().startswith(chr(44)) else chr(10) + sql}" if "logs" in sql else sql
        return f

    return keep


def money(*names):
    return {n: F.round(n, 4) for n in names}


_OVERVIEW = """count(*) AS request_count, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'error') AS error_count,
 count(*) FILTER (attempt_index > 1) AS retry_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(billable_input_tokens), 0)::BIGINT AS billable_input_tokens,
 coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(cache_read_tokens), 0)::BIGINT AS cache_read_tokens, coalesce(sum(cache_creation_tokens), 0)::BIGINT AS cache_creation_tokens,
 coalesce(sum(reasoning_tokens), 0)::BIGINT AS reasoning_tokens, round(sum(total_cost_usd), 4) AS total_cost_usd, round(avg(duration_ms), 4) AS avg_duration_ms, round(avg(ttft_ms), 4) AS avg_ttft_ms"""


@query(f"SELECT {_OVERVIEW} FROM logs WHERE started_at >= {START} AND started_at < {END}")
def usage_overview(spark, d):
    return U.overview(usage_logs(spark, d).where(U.in_window(START, END))).withColumns(money("total_cost_usd", "avg_duration_ms", "avg_ttft_ms"))


@query(f"SELECT {_OVERVIEW} FROM logs WHERE started_at >= {END} AND started_at < {END}")
def usage_overview_of_nothing(spark, d):
    return U.overview(usage_logs(spark, d).where(U.in_window(END, END))).withColumns(money("total_cost_usd", "avg_duration_ms", "avg_ttft_ms"))


def _bucket_sql(step, minutes=OFFSET):
    return f"((started_at + {minutes * 60000}) // {step}) * {step} - {minutes * 60000}"


_BUCKET = """count(*) AS request_count, count(*) FILTER (status = 'error') AS error_count, sum(billable_input_tokens)::BIGINT AS billable_input_tokens,
 sum(output_tokens)::BIGINT AS output_tokens, round(sum(total_cost_usd), 4) AS total_cost_usd"""


@query(f"""
, spine AS (SELECT unnest(generate_series((({START} + {OFFSET * 60000}) // {U.HOUR}) * {U.HOUR} - {OFFSET * 60000}, {END - 1}, {U.HOUR})) AS bucket_start),
found AS (SELECT {_bucket_sql(U.HOUR)} AS bucket_start, {_BUCKET} FROM logs WHERE started_at >= {START} AND started_at < {END} GROUP BY 1)
SELECT bucket_start, coalesce(request_count, 0) AS request_count, coalesce(error_count, 0) AS error_count, coalesce(billable_input_tokens, 0) AS billable_input_tokens,
 coalesce(output_tokens, 0) AS output_tokens, total_cost_usd FROM spine LEFT JOIN found USING (bucket_start)""")
def usage_buckets(spark, d):
    return U.buckets(usage_logs(spark, d), START, END, U.HOUR, OFFSET).withColumns(money("total_cost_usd")).orderBy("bucket_start")


@query(f"SELECT {_bucket_sql(U.DAY, -480)} AS bucket_start, {_BUCKET} FROM logs WHERE started_at >= {START} AND started_at < {END} GROUP BY 1")
def usage_buckets_by_local_day(spark, d):
    return U.buckets(usage_logs(spark, d), START, END, U.DAY, -480, fill=False).withColumns(money("total_cost_usd"))


@query(f"""SELECT coalesce(provider_id, '(unknown)') AS provider_id, coalesce(model_id, '(unknown)') AS model_id, {_bucket_sql(U.DAY)} AS bucket_start,
 min(provider_type) AS provider_type, count(*) AS request_count FROM logs WHERE started_at >= {START} AND started_at < {END} GROUP BY 1, 2, 3""")
def usage_model_buckets(spark, d):
    return U.model_buckets(usage_logs(spark, d), START, END, U.DAY, OFFSET)


@query("""SELECT provider_id, model_id, min(provider_type) AS provider_type, count(*) AS request_count, count(*) FILTER (status = 'success') AS success_count,
 sum(billable_input_tokens)::BIGINT AS billable_input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(total_cost_usd), 4) AS total_cost_usd FROM logs GROUP BY 1, 2""")
def usage_by_model(spark, d):
    return U.by_model(usage_logs(spark, d)).withColumns(money("total_cost_usd"))


_LOG = ("id", "session_id", "provider_id", "model_id", "status", "started_at")


@query(f"""SELECT id, session_id, provider_id, model_id, status, started_at, (SELECT count(*) FROM logs WHERE status = 'error' AND started_at >= {START}) AS total
 FROM logs WHERE status = 'error' AND started_at >= {START} ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 100""")
def usage_logs_page(spark, d):
    rows = usage_logs(spark, d).where(U.equal_to(status="error", model_id=None) & (F.col("started_at") >= START))
    return paging.page(rows.select(*_LOG), [F.desc("started_at"), F.desc("id")], limit=50, offset=100)


@query("SELECT id, session_id, provider_id, model_id, status, started_at FROM logs WHERE (provider_id = 'p1' AND model_id = 'click') OR (provider_id IS NULL AND model_id = 'view') OR (provider_id = 'p2' AND model_id IS NULL)")
def usage_logs_of_pairs(spark, d):
    return U.only_pairs(usage_logs(spark, d), [("p1", "click"), (None, "view"), ("p2", None)], ("provider_id", "model_id")).select(*_LOG)


@query("SELECT id, http_status_code FROM logs WHERE http_status_code IN (429, 503) AND session_id IN ('s1', 's2', 's3')")
def usage_logs_of_codes(spark, d):
    codes = U.status_codes(["429", "x", " 503", ""])
    return usage_logs(spark, d).where(U.equal_to(http_status_code=codes, session_id=["s1", "s2", "s3"])).select("id", "http_status_code")


@query(f"SELECT count(DISTINCT session_id) AS sessions FROM logs WHERE started_at >= {START}")
def usage_distinct_sessions(spark, d):
    return usage_logs(spark, d).where(F.col("started_at") >= START).agg(F.countDistinct("session_id").alias("sessions"))


@query("SELECT session_id, percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms) AS percentile, max(duration_ms) AS max FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at DESC, id DESC) AS rn FROM logs) WHERE rn <= 800 GROUP BY 1")
def usage_nearest_rank(spark, d):
    from quern.operators.sequences import newest

    return U.nearest_rank(newest(usage_logs(spark, d), 800, ["session_id"], ["started_at", "id"]), "duration_ms", 0.95, ("session_id",))


@query("SELECT s AS status, count(id) AS n FROM (VALUES ('success'), ('error'), ('pending')) t(s) LEFT JOIN logs ON status = s GROUP BY s")
def usage_count_by_status(spark, d):
    return U.count_by_status(usage_logs(spark, d), ("success", "error", "pending"))


@query("SELECT count(*) AS recent FROM logs WHERE started_at >= (SELECT max(started_at) FROM logs) - 36 * 3600000")
def usage_trailing_hours(spark, d):
    logs = usage_logs(spark, d)
    last = logs.agg(F.max("started_at").alias("last"))
    return logs.join(F.broadcast(last), F.col("started_at") >= F.col("last") - 36 * U.HOUR).agg(F.count("*").alias("recent"))


@query("SELECT session_id, count(*) AS n, max(started_at) AS latest FROM logs GROUP BY 1")
def usage_session_index(spark, d):
    return usage_logs(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.max("started_at").alias("latest")).orderBy(F.desc("latest"), "session_id")


@query("SELECT session_id, arg_min(id, (started_at, id)) AS oldest, sum(duration_ms)::BIGINT AS size FROM logs GROUP BY 1")
def usage_cache_size_and_oldest(spark, d):
    return usage_logs(spark, d).groupBy("session_id").agg(F.min_by("id", F.struct("started_at", "id")).alias("oldest"), F.sum("duration_ms").alias("size"))


@query("SELECT model_id, nullif(sum(coalesce(ttft_ms, 0))::BIGINT, 0) AS ttft_ms, nullif(sum(CASE WHEN status = 'x' THEN 1 ELSE 0 END)::BIGINT, 0) AS none FROM logs GROUP BY 1")
def usage_sum_or_absent(spark, d):
    return usage_logs(spark, d).groupBy("model_id").agg(F.nullif(F.sum(F.coalesce("ttft_ms", F.lit(0))), F.lit(0)).alias("ttft_ms"), F.nullif(F.sum(F.when(F.col("status") == "x", 1).otherwise(0)), F.lit(0)).alias("none"))


@query("""SELECT count(DISTINCT CASE WHEN user_id % 10 <> 3 THEN concat(user_id, '|', model_id, '|', started_at // 3600000) END) AS visits, count(*) FILTER (user_id % 10 = 3) AS bot_rows FROM logs WHERE model_id IS NOT NULL""")
def usage_distinct_visits(spark, d):
    logs = usage_logs(spark, d).where("model_id IS NOT NULL")
    return U.distinct_visits(logs, ("user_id", "model_id"), F.timestamp_millis("started_at"), F.col("user_id") % 10 == 3)


# Costs, tokens, ratios.


@query("""SELECT id, greatest(0, input_tokens - greatest(0, cache_read_tokens) - greatest(0, cache_creation_tokens)) AS billable,
 CASE WHEN model_id IN ('view', 'click') THEN round(input_tokens * 3.0 / 1e6, 9) END AS input_cost, CASE WHEN model_id IN ('view', 'click') OR model_id = 'error' THEN round(coalesce(CASE WHEN model_id IN ('view', 'click') THEN input_tokens * 3.0 / 1e6 END, 0) + output_tokens * 15.0 / 1e6, 9) END AS total_cost FROM logs""")
def cost_of_rows(spark, d):
    prices = spark.createDataFrame([("view", 3.0, 15.0), ("click", 3.0, 15.0), ("error", None, 15.0)], "model string, price_in double, price_out double")
    rows = usage_logs(spark, d).join(F.broadcast(prices), F.col("model_id") == F.col("model"), "left")
    a, b = S.part_cost(F.col("input_tokens"), F.col("price_in")), S.part_cost(F.col("output_tokens"), F.col("price_out"))
    return rows.select("id", S.billable_input(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens")).alias("billable"), F.round(a, 9).alias("input_cost"), F.round(S.total_cost(a, b), 9).alias("total_cost"))


@query("SELECT id, round((billable_input_tokens * 3.0 + output_tokens * 15.0 + cache_read_tokens * 0.3 + cache_creation_tokens * 3.75 + reasoning_tokens * 6.0) / 1e6, 9) AS cost FROM logs")
def cost_by_client(spark, d):
    three, fifteen = F.lit(3.0), F.lit(15.0)
    cost = S.client_cost(F.col("billable_input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("reasoning_tokens"), three, fifteen)
    return usage_logs(spark, d).select("id", F.round(cost, 9).alias("cost"))


@query("SELECT id, reasoning_tokens + greatest(0, cache_creation_tokens - reasoning_tokens - output_tokens) AS five, output_tokens AS hour FROM logs")
def cost_cache_write_split(spark, d):
    part = S.cache_write_split(F.col("cache_creation_tokens"), F.col("reasoning_tokens"), F.col("output_tokens"))
    return usage_logs(spark, d).select("id", part["five"].alias("five"), part["hour"].alias("hour"))


@query("""SELECT id, round(coalesce(cache_read_tokens / nullif(billable_input_tokens + cache_read_tokens + cache_creation_tokens, 0), 0), 9) AS hit_rate,
 round(least(1, coalesce(cache_read_tokens / nullif(input_tokens, 0), 0)), 9) AS read_ratio, round(coalesce(cache_read_tokens / nullif(cache_read_tokens + reasoning_tokens, 0), 0), 9) AS session_rate,
 round(coalesce(cache_read_tokens / nullif(input_tokens + cache_read_tokens, 0), 0), 9) AS share, round(coalesce((input_tokens + output_tokens) * 1000.0 / nullif(duration_ms, 0), 0), 6) AS tps FROM logs""")
def cost_ratios(spark, d):
    c = F.col
    return usage_logs(spark, d).select(
        "id",
        F.round(S.cache_hit_rate(c("billable_input_tokens"), c("cache_read_tokens"), c("cache_creation_tokens")), 9).alias("hit_rate"),
        F.round(S.cache_read_ratio(c("input_tokens"), c("cache_read_tokens")), 9).alias("read_ratio"),
        F.round(S.session_hit_rate(c("cache_read_tokens"), c("reasoning_tokens")), 9).alias("session_rate"),
        F.round(S.cache_share(c("input_tokens"), c("cache_read_tokens")), 9).alias("share"),
        F.round(S.tokens_per_second(c("input_tokens") + c("output_tokens"), c("duration_ms")), 6).alias("tps"),
    )


@query("SELECT id, CASE WHEN http_status_code IS NULL THEN NULL WHEN http_status_code >= 500 THEN 'http_5xx' ELSE 'http_' || http_status_code END AS error_class, CASE WHEN input_tokens % 611 >= 500 THEN 'http_5xx' ELSE 'http_' || (input_tokens % 611) END AS any_class FROM logs WHERE status = 'error'")
def usage_error_classes(spark, d):
    return usage_logs(spark, d).where("status = 'error'").select("id", S.status_class(F.col("http_status_code")).alias("error_class"), S.status_class(F.col("input_tokens") % 611).alias("any_class"))


@query("SELECT id, CASE WHEN k < 1 THEN 0 WHEN k <= 4 THEN CAST(pow(2, k) AS INT) WHEN k <= 40 THEN 600 END AS wait FROM (SELECT id, input_tokens // 20 AS k FROM logs)")
def usage_backoff(spark, d):
    return usage_logs(spark, d).select("id", S.backoff_seconds((F.col("input_tokens") / 20).cast("int")).cast("int").alias("wait"))


@query("""SELECT id, CASE WHEN o % 9 = 0 THEN 30 + o % 5 WHEN k < 4 THEN CAST(pow(2, k + 1) AS INT) WHEN k < 40 THEN 600 ELSE 0 END AS seconds,
 CASE WHEN o % 9 = 0 THEN 'retry-after' WHEN k < 4 THEN 'fast' WHEN k < 40 THEN 'minute' ELSE 'timeout' END AS phase FROM (SELECT id, input_tokens // 20 AS k, output_tokens AS o FROM logs)""")
def usage_retry_delays(spark, d):
    o = F.col("output_tokens")
    hint = F.when(o % 9 == 0, F.concat(F.lit(" "), 30 + o % 5)).when(o % 9 == 3, F.lit("0")).when(o % 9 == 6, F.lit("soon"))
    return usage_logs(spark, d).select("id", S.retry_delay((F.col("input_tokens") / 20).cast("int"), hint).alias("r")).select("id", "r.seconds", "r.phase")


@query(f"""SELECT 'absent' AS given, count(*) AS n FROM logs UNION ALL SELECT 'null', count(*) FILTER (provider_id IS NULL) FROM logs UNION ALL SELECT 'value', count(*) FILTER (provider_id = 'p1') FROM logs
 UNION ALL SELECT 'unassigned', count(*) FILTER (provider_id IS NULL) FROM logs UNION ALL SELECT 'unassigned with value', count(*) FILTER (provider_id = 'p1') FROM logs""")
def usage_logs_by_tri_state(spark, d):
    logs = usage_logs(spark, d)
    given = {"absent": {}, "null": {"provider_id": None}, "value": {"provider_id": "p1"}}
    chosen = {name: U.tri_state(**filters) for name, filters in given.items()}
    chosen["unassigned"] = U.assigned_to("provider_id", None, True)
    chosen["unassigned with value"] = U.assigned_to("provider_id", "p1", True)
    # One pass: each filter is a conditional count.
    counts = logs.agg(*[F.count_if(c).alias(name) for name, c in chosen.items()])
    return counts.unpivot([], list(chosen), "given", "n")


@query("""SELECT session_id, coalesce(arg_max(input_tokens, (started_at, id)) FILTER (input_tokens > 0 OR output_tokens > 0), 0) AS input_tokens, coalesce(arg_max(output_tokens, (started_at, id)) FILTER (input_tokens > 0 OR output_tokens > 0), 0) AS output_tokens,
 arg_max(cache_read_tokens, (started_at, id)) AS cache_read_tokens, arg_max(ttft_ms, (started_at, id)) FILTER (ttft_ms IS NOT NULL) AS ttft_ms FROM logs GROUP BY 1""")
def usage_replaced(spark, d):
    return U.replaced_usage(usage_logs(spark, d), ["session_id"], ["started_at", "id"], ("input_tokens", "output_tokens"), ("cache_read_tokens", "ttft_ms"))


# A number of thousands is exact in binary where it is a multiple of 125; then alone can a tie come up, which goes up.
@query("""SELECT l_orderkey, l_linenumber, CASE WHEN n <= 0 THEN '0' WHEN n < 1000 THEN printf('%.0f', n) WHEN CAST(two AS DOUBLE) < 10 THEN two || 'k' WHEN CAST(one AS DOUBLE) < 100 THEN one || 'k' ELSE none || 'k' END AS short
 FROM (SELECT *, printf('%.2f', x) AS two, printf('%.1f', x) AS one, printf('%.0f', x) AS none FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS n, floor(l_extendedprice) / 1e3 + CASE WHEN floor(l_extendedprice) % 125 = 0 THEN 1e-9 ELSE 0 END AS x FROM lineitem))""")
def format_short_numbers(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", S.short_number(F.col("n")).alias("short"))
