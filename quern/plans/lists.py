"""Lists, pages, joins, retention and mutations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quern.functions import scalar as S
from quern.operators import merge, paging as P, relate as R, sequences as Q, usage as U
from quern.plans.kit import Catalog
from quern.sources import grids, sinks
from quern.sources.standins import memory_entries, messages, read, usage_logs

C = Catalog()
query, QUERIES, ORACLE_SQL = C.query, C.queries, C.sql
ROWS = ("id", "session_id", "status", "started_at")


# Sorting and paging.


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 40 OFFSET 20")
def page_by_two_keys(spark, d):
    return P.page(read(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 40, 20, total=None)


@query("SELECT id, status, priority FROM memory ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, updated_at DESC, id LIMIT 60", "memory")
def page_by_status_rank(spark, d):
    return memory_entries(spark, d).orderBy(P.ranked(F.col("status"), ("active", "warm")), F.desc("updated_at"), "id").select("id", "status", "priority").limit(60)


@query("SELECT p_partkey, p_name FROM part ORDER BY (p_size > 45) DESC, lower(p_name), p_partkey LIMIT 30")
def page_pinned_first(spark, d):
    return read(spark, d, "part").orderBy((F.col("p_size") > 45).desc(), P.natural_key(F.col("p_name")), "p_partkey").select("p_partkey", "p_name").limit(30)


@query("""SELECT doc_id, name FROM (SELECT doc_id, word || CASE WHEN doc_id % 3 = 0 THEN '0' ELSE '' END || (doc_id * 37 % 211) AS name, strip_accents(lower(word)) AS w, doc_id * 37 % 211 AS n FROM (
 SELECT doc_id, substring(regexp_replace(text, '[^a-zA-ZàâäéèêëîïôöùûüçñáíóúÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÁÍÓÚ]', '', 'g'), 1, 3) AS word FROM documents)) ORDER BY w, n, doc_id LIMIT 80""")
def names_in_locale_order(spark, d):
    letters = F.regexp_replace("text", "[^a-zA-ZàâäéèêëîïôöùûüçñáíóúÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑÁÍÓÚ]", "")
    number = F.concat(F.when(F.col("doc_id") % 3 == 0, "0").otherwise(""), F.col("doc_id") * 37 % 211)
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.substring(letters, 1, 3), number).alias("name"))
    return rows.orderBy(P.natural_key(F.col("name")), "doc_id").limit(80)


@query("SELECT id, session_id, status, started_at, true AS has_more FROM logs WHERE (started_at, id) < (1706000000000, '5') ORDER BY started_at DESC, id DESC LIMIT 100", "logs")
def page_by_time_key(spark, d):
    return P.keyset(usage_logs(spark, d).select(*ROWS), [("started_at", "desc"), ("id", "desc")], P.clamp(None, "timeline"), [1_706_000_000_000, "5"])


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice, true AS has_more FROM orders WHERE o_orderpriority > '4-NOT SPECIFIED'
 AND (o_totalprice < 300000 OR (o_totalprice = 300000 AND o_orderkey < 5)) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey DESC LIMIT 100""")
def page_by_three_keys(spark, d):
    rows = read(spark, d, "orders").where("o_orderpriority > '4-NOT SPECIFIED'").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return P.keyset(rows, [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "desc")], 100, ["5-LOW", 300_000.0, 5])


@query("SELECT id, session_id, status, started_at, true AS has_more FROM logs WHERE started_at < 1705000000000 OR (started_at = 1705000000000 AND id < '7') ORDER BY started_at DESC, id DESC LIMIT 20", "logs")
def page_by_two_keys_more(spark, d):
    return P.keyset(usage_logs(spark, d).select(*ROWS), [("started_at", "desc"), ("id", "desc")], P.clamp(None, "goals"), [1_705_000_000_000, "7"])


@query("SELECT * FROM (SELECT id, created_at FROM messages ORDER BY created_at DESC, id DESC LIMIT 50) ORDER BY created_at, id", "messages")
def newest_reversed(spark, d):
    return messages(spark, d).select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(50).orderBy("created_at", "id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> 17 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top_five_without_active(spark, d):
    return read(spark, d, "customer").where("c_custkey <> 17").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal").limit(5)


@query("SELECT s_suppkey, s_name, s_acctbal < 0 AS is_dir FROM supplier ORDER BY is_dir DESC, s_name, s_suppkey LIMIT 40")
def directories_first(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") < 0).alias("is_dir")).orderBy(F.desc("is_dir"), "s_name", "s_suppkey").limit(40)


@query("SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, id DESC) AS n, started_at, (SELECT max(started_at) FROM logs) AS last FROM logs) WHERE n <= 8 AND started_at > last - 7 * 86400000", "logs")
def recent_residents(spark, d):
    logs = usage_logs(spark, d)
    last = logs.agg(F.max("started_at").alias("last"))
    young = logs.join(F.broadcast(last)).where(F.col("started_at") > F.col("last") - 7 * U.DAY)
    return Q.newest(young, 8, ["user_id"], ["started_at", "id"]).select("user_id", "id")


@query("SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 100 WHEN starts_with(lower(p_name), 'red') THEN 90 WHEN contains(lower(p_name), ' red') THEN 88 WHEN contains(lower(p_name), 'red') THEN 80 - instr(lower(p_name), 'red') ELSE 0 END + CASE WHEN p_size > 40 THEN 1000 ELSE 0 END AS score FROM part) WHERE score % 1000 > 0 ORDER BY score DESC, p_partkey LIMIT 20")
def launcher_candidates(spark, d):
    name = F.lower("p_name")
    ladder = F.when(name == "red", 100).when(name.startswith("red"), 90).when(name.contains(" red"), 88).when(name.contains("red"), 80 - F.instr(name, "red")).otherwise(0)
    score = ladder + F.when(F.col("p_size") > 40, 1000).otherwise(0)
    return read(spark, d, "part").select("p_partkey", score.cast("long").alias("score")).where("score % 1000 > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


# Joins.


@query("SELECT m.id, c.c_name, m.created_at FROM messages m JOIN customer c ON m.session_id = c.c_custkey WHERE lower(m.content) LIKE '%tion%' ORDER BY m.created_at DESC, m.id LIMIT 50", "messages")
def search_messages(spark, d):
    rows = messages(spark, d).where(F.lower("content").like("%tion%")).select("id", "session_id", "created_at")
    owners = read(spark, d, "customer").select("c_custkey", "c_name")
    return rows.join(owners, rows.session_id == owners.c_custkey).select("id", "c_name", "created_at").orderBy(F.desc("created_at"), "id").limit(P.clamp(None, "content_search"))


@query("SELECT n_nationkey, n_name, coalesce(n, 0) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def projects_with_counts(spark, d):
    return R.with_counts(read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "customer"), "n_nationkey", "c_nationkey", "customers")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def with_finished_orders(spark, d):
    done = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return read(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey))")
def superseded_open_goals(spark, d):
    open_ = read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.superseded(open_, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate) AS at FROM orders GROUP BY 1")
def latest_of_each_parent(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").alias("at"))


@query("SELECT session_id, count(*) AS n FROM logs WHERE started_at > coalesce((SELECT max(started_at) FROM logs WHERE id = '5000'), 0) GROUP BY 1", "logs")
def since_reset(spark, d):
    logs = usage_logs(spark, d)
    reset = logs.where("id = '5000'").agg(F.coalesce(F.max("started_at"), F.lit(0)).alias("reset_at"))
    return logs.join(F.broadcast(reset), F.col("started_at") > F.col("reset_at")).groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(items, 0) AS items, parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def parents_with_child_arrays(spark, d):
    parents = read(spark, d, "orders").select("o_orderkey")
    joined = R.with_children(parents, read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"], "children")
    return joined.select("o_orderkey", F.when(F.col("children").isNull(), 0).otherwise(F.size("children")).cast("long").alias("items"), F.transform("children", lambda x: x["l_partkey"]).alias("parts"))


@query("""SELECT a.id AS call_id, coalesce(b.id, '(no result)') AS result_id, a.session_id, a.sort_order FROM messages a LEFT JOIN messages b ON a.session_id = b.session_id AND b.sort_order = a.sort_order + 1 AND b.role = 'assistant' WHERE a.role = 'user'""", "messages")
def calls_with_results(spark, d):
    rows = messages(spark, d)
    calls = rows.where("role = 'user'").select("session_id", "sort_order", F.col("id").alias("call_id"), (F.col("sort_order") + 1).alias("call_key"))
    results = rows.where("role = 'assistant'").select("session_id", F.col("sort_order").alias("call_key"), F.col("id").alias("result_id"))
    return R.paired(calls, results, ["session_id", "call_key"], {"result_id": "(no result)"}).select("call_id", "result_id", "session_id", "sort_order").orderBy("session_id", "sort_order")


@query("""SELECT c_custkey, goal, goal_at, open_runs FROM (SELECT c_custkey FROM customer) JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS goal, max(o_orderdate) AS goal_at FROM orders GROUP BY 1) ON c_custkey = o_custkey
 LEFT JOIN (SELECT o_custkey AS k, count(*) AS open_runs FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = k""")
def goal_ledger(spark, d):
    orders = read(spark, d, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("goal"), F.max("o_orderdate").alias("goal_at"))
    # One pass for both: the open runs are a conditional count under the same key.
    runs = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.nullif(F.count_if(F.col("o_orderstatus") == "O"), F.lit(0)).alias("open_runs"))
    return read(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey")).join(runs, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "goal", "goal_at", "open_runs")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def without_children(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey")
    return read(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT a.o_orderkey AS o_orderkey, b.n IS NULL AS missing FROM orders a LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.o_orderkey = b.l_orderkey")
def verify_children(spark, d):
    returned = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return read(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("n").isNull().alias("missing"))


@query("""SELECT s.session_id AS session_id, count(*) FILTER (s.at IS NULL OR m.created_at > s.at) AS since FROM messages m JOIN (SELECT session_id, max(CASE WHEN meta LIKE '%compactSummary%' THEN created_at END) AS at FROM messages GROUP BY 1) s ON m.session_id = s.session_id GROUP BY 1""", "messages")
def messages_since_snapshot(spark, d):
    w = W.partitionBy("session_id")
    at = F.max(F.when(F.col("meta").contains("compactSummary"), F.col("created_at"))).over(w)
    return messages(spark, d).withColumn("at", at).groupBy("session_id").agg(F.count_if(F.col("at").isNull() | (F.col("created_at") > F.col("at"))).alias("since"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'O' OR o_totalprice > 400000) WHERE n = 1")
def best_route(spark, d):
    one, two = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O"
    rows = read(spark, d, "orders").where(one | two | (F.col("o_totalprice") > 400000))
    w = W.partitionBy("o_custkey").orderBy(F.when(one, 0).when(two, 1).otherwise(2), F.desc("o_orderdate"), "o_orderkey")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("o_custkey", "o_orderkey")


# Retention, mutations.


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY started_at DESC, id DESC) AS n FROM logs WHERE started_at >= 1704067200000 + 86400000) WHERE n <= 20000", "logs")
def retention_newest(spark, d):
    young = usage_logs(spark, d).where(F.col("started_at") >= 1_704_067_200_000 + U.DAY)
    return young.orderBy(F.desc("started_at"), F.desc("id")).limit(20_000).select("id")  # a global top-k, no single-task window


@query("SELECT user_id, id FROM (SELECT *, user_id % 7 = 0 AS pin, row_number() OVER (PARTITION BY user_id, user_id % 7 = 0 ORDER BY started_at DESC, id DESC) AS n FROM logs WHERE user_id % 7 = 0 OR coalesce(ttft_ms + 1704067200000, started_at) >= 1704067200000) WHERE pin OR n <= 20", "logs")
def retention_with_pins(spark, d):
    age = F.coalesce(F.col("ttft_ms") + 1_704_067_200_000, F.col("started_at")) >= 1_704_067_200_000
    return Q.retained(usage_logs(spark, d), age, 20, ["started_at", "id"], ["user_id"], F.col("user_id") % 7 == 0).select("user_id", "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'N' FROM orders WHERE o_orderkey % 100 = 0")
def upsert_by_key(spark, d):
    base = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = base.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(base.where("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return merge.upsert(base, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'N' FROM orders WHERE o_orderkey % 100 = 0")
def insert_if_absent(spark, d):
    base = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = base.where("o_orderkey % 3 = 0").unionByName(base.where("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus")))
    return merge.insert_absent(base, new, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 50 <> 0 UNION ALL SELECT l_orderkey, 1, max(l_partkey) FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY 1")
def replace_children(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = items.where("l_orderkey % 50 = 0").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.max("l_partkey").alias("l_partkey"))
    return merge.replace_children(items, new, "l_orderkey")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN CASE status WHEN 'cold' THEN 'warm' WHEN 'warm' THEN 'active' ELSE status END ELSE status END AS status FROM memory", "memory")
def reheat_recalled(spark, d):
    rows = memory_entries(spark, d).select("id", "status")
    return rows.select("id", F.when(F.col("id") % 2 == 0, S.reheat(F.col("status"))).otherwise(F.col("status")).alias("status"))


@query("SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at, id) AS n FROM logs WHERE status = 'error' AND started_at <= 1706000000000 AND coalesce(ttft_ms, 0) < 200) WHERE n = 1", "logs")
def claim_due_follow_up(spark, d):
    return merge.claim(usage_logs(spark, d), (F.col("status") == "error") & (F.col("started_at") <= 1_706_000_000_000), F.coalesce("ttft_ms", F.lit(0)) < 200, ["session_id"], ["started_at", "id"]).select("session_id", "id")


@query("SELECT session_id, sum(CASE WHEN status = 'error' THEN 0 ELSE 1 END)::BIGINT AS revision, max(started_at) AS at FROM logs GROUP BY 1", "logs")
def counters_from_deltas(spark, d):
    deltas = usage_logs(spark, d).select("session_id", F.when(F.col("status") == "error", 0).otherwise(1).alias("delta"), "started_at")
    return merge.counters(deltas, ["session_id"], "delta", "started_at")


@query("SELECT id, CASE WHEN http_status_code IS NOT NULL AND session_id NOT IN ('s1', 's2', 's3') THEN 'aborted' ELSE status END AS status FROM logs", "logs")
def finalize_orphans(spark, d):
    logs = usage_logs(spark, d)
    live = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session_id string")
    return merge.finalize_orphans(logs, live, "session_id", F.col("http_status_code").isNotNull(), "aborted").select("id", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_cascade(spark, d):
    gone = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT 'message' AS kind, id, CASE WHEN role = 'assistant' THEN 'archived' ELSE 'open' END AS status FROM messages UNION ALL SELECT 'memory', CAST(id AS STRING), CASE WHEN status = 'deprecated' THEN 'archived' ELSE status END FROM memory", "messages", "memory")
def archive_two_tables(spark, d):
    a = messages(spark, d).select(F.lit("message").alias("kind"), "id", F.when(F.col("role") == "assistant", "archived").otherwise("open").alias("status"))
    b = memory_entries(spark, d).select(F.lit("memory").alias("kind"), F.col("id").cast("string").alias("id"), F.when(F.col("status") == "deprecated", "archived").otherwise(F.col("status")).alias("status"))
    return a.unionByName(b)


@query("""SELECT 'changed' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 <> 3 UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT 'added', 0""")
def verify_copy(spark, d):
    old = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = old.where("o_orderkey % 7 <> 3").withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_custkey")))
    return merge.verify_copy(old, new, ["o_orderkey"])



@query("SELECT session_id, id, greatest(created_at, newest + 1) AS created_at, session_id % 2 = 0 AS committed FROM (SELECT session_id, id, created_at - 600000 AS created_at, max(created_at) OVER (PARTITION BY session_id) AS newest, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS n FROM messages) WHERE n = 1", "messages")
def commit_snapshots(spark, d):
    w = W.partitionBy("session_id")
    rows = messages(spark, d).withColumn("newest", F.max("created_at").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("created_at")))).where("n = 1")
    return merge.commit(rows.withColumn("created_at", F.col("created_at") - 600_000).withColumn("expected", F.col("session_id") % 2).withColumn("revision", F.lit(0)), "created_at", "newest", "expected", "revision").select("session_id", "id", "created_at", "committed")


@query("""SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 'second' ELSE 'first' END AS written FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'more' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 0""")
def append_and_overwrite(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path = sinks.shared_folder(spark, "orders")
    sinks.append(orders.withColumn("written", F.lit("first")), path, "o_orderstatus")
    sinks.append(orders.where("o_orderstatus = 'F' AND o_orderkey % 10 = 0").withColumn("written", F.lit("more")), path, "o_orderstatus")
    for _ in range(2):  # a rerun leaves no trace
        sinks.overwrite_partitions(orders.where("o_orderstatus = 'P'").withColumn("written", F.lit("second")), path, "o_orderstatus")
    return spark.read.schema("o_orderkey long, written string, o_orderstatus string").parquet(path).select("o_orderkey", "o_orderstatus", "written")


@query("""SELECT ['s_suppkey', 's_name', 'note'] AS cells, 1 AS headers UNION ALL SELECT [CAST(s_suppkey AS VARCHAR), s_name, CASE s_suppkey % 3 WHEN 0 THEN 'a, "b"' WHEN 1 THEN 'two' || chr(10) || 'lines' ELSE '' END], 0 FROM supplier""")
def grid_round_trip(spark, d):
    path = sinks.shared_folder(spark, "grid")
    note = F.when(F.col("s_suppkey") % 3 == 0, 'a, "b"').when(F.col("s_suppkey") % 3 == 1, "two\nlines")
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", note.alias("note"))
    grids.write_csv(rows.coalesce(1), path)  # one grid is one file
    return grids.read_grid(spark, path).select("cells", (F.col("row_no") == 0).cast("int").alias("headers"))


@query("""SELECT p_partkey, price FROM part LEFT JOIN (SELECT p_type AS t, arg_min(p_retailprice, (p_brand, p_partkey)) AS price FROM part WHERE p_size > 5 GROUP BY 1) ON p_type = t""")
def first_catalog_price(spark, d):
    part = read(spark, d, "part")
    entry = F.struct("p_partkey", F.col("p_type").alias("id"), F.col("p_retailprice").alias("price"))
    catalog = part.where("p_size > 5").groupBy(F.col("p_brand").alias("position")).agg(F.sort_array(F.collect_list(entry)).alias("models"))
    return R.lookup_first(part.select("p_partkey", "p_type"), catalog, "models", "id", "price", "p_type", "price").select("p_partkey", "price")


# Dedupe.


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def move_to_front(spark, d):
    return Q.latest_each(read(spark, d, "customer").withColumn("back", -F.col("c_custkey")), ["c_mktsegment", "c_nationkey"], ["c_acctbal", "back"]).select("c_mktsegment", "c_custkey")


@query("""SELECT id, query_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_no, rank) AS n FROM (SELECT doc_id AS id, 0 AS query_no, n_chars AS rank FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT doc_id, 1, -n_chars FROM documents WHERE doc_id % 2 = 0)) WHERE n = 1""")
def union_first_wins(spark, d):
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("rank"))
    return merge.union_first([ids.where("id % 3 = 0"), ids.where("id % 2 = 0").withColumn("rank", -F.col("rank"))], ["id"], ["rank"])


@query("SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY src, p_partkey) AS m FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY src, p_partkey) AS n FROM (SELECT *, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS src FROM part)) WHERE n = 1) WHERE m = 1")
def dedupe_by_name_then_target(spark, d):
    rows = read(spark, d, "part").withColumn("src", F.when(F.col("p_size") > 25, 0).otherwise(1))
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("src", "p_partkey"))).where("n = 1").drop("n")
    return first(first(rows, F.lower("p_name")), "p_brand", "p_type").select("p_partkey")


@query("SELECT conv_id, pos, side FROM (SELECT conv_id, turn AS pos, 'new' AS side FROM conversations WHERE turn >= 2 AND turn <> 3 UNION ALL SELECT conv_id, turn, 'old' FROM conversations WHERE turn < 2) WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 2)")
def splice_at_anchor(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"))
    return merge.splice(rows, rows, ["conv_id"], "pos", F.col("pos") == 2, F.col("pos") == 3).select("conv_id", "pos", "side")
