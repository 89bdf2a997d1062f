"""Files, logs and dispatched tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quern.operators import dispatch as D, files as O
from quern.operators.baseline import WebLogBaseline
from quern.plans.kit import Catalog
from quern.sources import sinks
from quern.sources.sinks import shared_folder
from quern.sources.standins import read, usage_logs

C = Catalog()
query, QUERIES, ORACLE_SQL = C.query, C.queries, C.sql


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '.log' AS name FROM orders WHERE o_orderkey % 4 IN (0, 3) AND CAST(o_orderdate AS DATE) < DATE '1997-12-03'")
def expired_daily_files(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 4
    name = F.when(kind == 1, F.concat(day, F.lit(".txt"))).when(kind == 2, F.concat(F.lit("1992-02-3"), F.col("o_orderkey") % 10, F.lit(".log"))).otherwise(F.concat(day, F.lit(".log")))
    files = read(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return O.expired_daily_files(files, "name", dt.date(1998, 1, 1), 30)


@query("""SELECT CAST(ts AS DATE) AS day, metric, count(DISTINCT CASE WHEN u < 3 THEN (date_trunc('hour', ts), user_id, u, p) END) AS n, count(*) FILTER (u >= 3) AS filtered_bots FROM (
 SELECT ts, user_id, u, p, CASE event_type WHEN 'view' THEN CASE WHEN p < 3 THEN 'page_view' END WHEN 'click' THEN 'web_click' ELSE CASE WHEN p IN (0, 3) THEN CASE u WHEN 1 THEN 'app_update' ELSE 'web_download_local' END END END AS metric
 FROM (SELECT *, event_id % 5 AS u, event_id // 5 % 4 AS p FROM events)) WHERE metric IS NOT NULL GROUP BY 1, 2""")
def web_log_counts(spark, d):
    return O.web_log_counts(_lines(spark, d))


def _lines(spark, d):
    """Lines of three web logs out of the event table."""
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    agent = pick(F.col("event_id") % 5, "Mozilla/5.0 (X11)", "electron-updater/6.1", "Mozilla/5.0 (Mac)", "GoogleBot/2.1", "-")
    which = F.floor(F.col("event_id") / 5) % 4
    log = F.when(F.col("event_type") == "view", "access").when(F.col("event_type") == "click", "clicks").otherwise("downloads")
    target = (
        F.when(log == "access", pick(which, "/", "/guide?from=x", "/a/b.html", "/logo.png"))
        .when(log == "clicks", F.concat(F.lit("/go?f="), which))
        .otherwise(pick(which, "/downloads/setup-1.exe", "/downloads/latest.yml", "/downloads/setup-1.exe.blockmap", "/downloads/setup-2.exe"))
    )
    line = F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), target, F.lit(' HTTP/1.1" 200 17 "-" "'), agent, F.lit('"'))
    return read(spark, d, "events").select(log.alias("log"), line.alias("line"))


#: The same lines as text, and then what a parser of such lines finds in them.
_PARSED = r"""lines AS (SELECT log, '10.0.0.' || user_id || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET ' || CASE log WHEN 'access' THEN ['/', '/guide?from=x', '/a/b.html', '/logo.png'][w + 1] WHEN 'clicks' THEN '/go?f=' || w
  ELSE ['/downloads/setup-1.exe', '/downloads/latest.yml', '/downloads/setup-1.exe.blockmap', '/downloads/setup-2.exe'][w + 1] END || ' HTTP/1.1" 200 17 "-" "' || ['Mozilla/5.0 (X11)', 'electron-updater/6.1', 'Mozilla/5.0 (Mac)', 'GoogleBot/2.1', '-'][event_id % 5 + 1] || '"' AS line
  FROM (SELECT *, event_id // 5 % 4 AS w, CASE event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'clicks' ELSE 'downloads' END AS log FROM events)),
 parts AS (SELECT log, regexp_extract(line, '^(\S+) \S+ \S+ \[([^\] ]+)[^\]]*\] "\S+ (\S+)[^"]*" [0-9]+ \S+ "[^"]*" "([^"]*)"', ['ip', 'at', 'target', 'agent']) AS p FROM lines),
 requests AS (SELECT log, p.ip AS ip, date_trunc('hour', strptime(p.at, '%d/%b/%Y:%H:%M:%S')) AS hour, p.target AS target, regexp_extract(p.target, '^[^?#]*') AS path, p.agent AS agent FROM parts),
 counted AS (SELECT *, CASE WHEN log = 'access' AND (path IN ('/', '/download', '/guide') OR suffix(path, '.html')) THEN 'page_view' WHEN log = 'clicks' THEN 'web_click'
  WHEN log = 'downloads' AND NOT suffix(path, '/latest.yml') AND NOT suffix(path, '.blockmap') THEN CASE WHEN regexp_matches(agent, 'electron-updater|electron-builder') THEN 'app_update' ELSE 'web_download_local' END END AS metric,
  agent IN ('', '-') OR regexp_matches(lower(agent), 'bot|spider|crawl|scan|curl|wget|python-requests|zgrab|masscan|headless') AS robot FROM requests),
 days AS (SELECT CAST(hour AS DATE) AS day, metric, count(DISTINCT CASE WHEN NOT robot THEN (hour, ip, agent, CASE WHEN log = 'clicks' THEN target ELSE path END) END) AS n FROM counted WHERE metric IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_PARSED} SELECT metric, sum(n)::BIGINT AS n, count(*) AS days FROM days WHERE day <= DATE '2024-01-20' GROUP BY 1")
def web_log_baseline(spark, d):
    """Runs of four days in turn over the same logs, two of them twice: each folds what has left its window."""
    kept = WebLogBaseline(spark, shared_folder(spark, "web-log"))
    lines = _lines(spark, d)
    for day in (10, 10, 13, 19, 19):
        kept.fold(lines, dt.date(2024, 1, day))
    return kept.summary(lines, dt.date(2024, 1, 20))


_INDEX = "SELECT p_partkey, p_name, p_brand || '/' || p_partkey AS path, CASE p_size % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'TXT' WHEN 2 THEN 'png' ELSE '' END AS extension, p_partkey * 7919 % 1000 AS modified FROM part"


def _index(spark, d):
    kind = F.col("p_size") % 4
    extension = F.when(kind == 0, "pdf").when(kind == 1, "TXT").when(kind == 2, "png").otherwise("")
    modified = F.col("p_partkey") * 7919 % 1000
    return read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_partkey").alias("path"), extension.alias("extension"), F.col("p_size").alias("size"), modified.alias("modified"), (extension == "").alias("is_folder"))


@query(f"SELECT path, modified FROM ({_INDEX}) WHERE lower(p_name) LIKE '%a%' AND lower(p_name) LIKE '%e%' AND extension IN ('pdf', 'TXT') ORDER BY modified DESC, path LIMIT 100 OFFSET 5")
def find_documents(spark, d):
    return O.find_files(_index(spark, d), " A  e", "document", offset=5).select("path", "modified")


@query(f"SELECT path, modified FROM ({_INDEX}) WHERE extension = '' ORDER BY p_name, path LIMIT 500")
def find_folders(spark, d):
    return O.find_files(_index(spark, d), None, "folder", "name", False, size=9999).select("path", "modified")


@query("""SELECT doc_id, CASE WHEN (doc_id % 7 <> 0) <> (doc_id % 5 <> 0) THEN true WHEN doc_id % 7 = 0 THEN false WHEN doc_id % 6 = 0 THEN md5(text) <> md5(lower(text))
 WHEN doc_id % 2 = 0 OR doc_id % 4 <> 1 OR doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 11 = 0 THEN 'p' ELSE '' END <> CASE WHEN doc_id % 4 <> 1 THEN replace(text, chr(13) || chr(10), chr(10)) ELSE '' END ELSE true END AS shown FROM documents""")
def changes_worth_showing(spark, d):
    when = lambda test, value: F.when(F.expr(f"doc_id % {test}"), value)
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    before = F.struct(F.expr("doc_id % 7 <> 0").alias("exists"), when("3 = 0", F.md5("text")).alias("hash"), when("2 = 0", F.col("text")).alias("text"), when("11 = 0", F.lit("p")).alias("preview"))
    after = F.struct(F.expr("doc_id % 5 <> 0").alias("exists"), when("6 = 0", F.md5(F.lower("text"))).alias("hash"), when("4 <> 1", crlf).alias("text"), F.lit(None).cast("string").alias("preview"))
    rows = read(spark, d, "documents").select("doc_id", before.alias("before"), after.alias("after"))
    return rows.select("doc_id", O.worth_showing("before", "after").alias("shown"))


STATES = ("pending", "sent", "acknowledged", "in_progress", "blocked", "completed", "failed", "cancelled", "completed_implicit")


@query(f"""SELECT id, refused, CASE WHEN done AND told IN ('pending', 'sent', 'acknowledged', 'in_progress') THEN 'completed_implicit' ELSE told END AS status FROM (
 SELECT o_orderkey AS id, c_nationkey % 2 = 0 AS done, l_orderkey IS NOT NULL AND (state IN ('completed', 'failed', 'cancelled') OR coalesce(named, '') = 'nonsense') AS refused,
  CASE WHEN l_orderkey IS NULL OR state IN ('completed', 'failed', 'cancelled') OR named = 'nonsense' THEN state WHEN coalesce(named, '') <> '' THEN named
   WHEN state = 'completed_implicit' THEN 'completed' WHEN state IN ('pending', 'sent') THEN 'acknowledged' ELSE state END AS told
 FROM (SELECT *, {list(STATES)}[o_orderkey % 9 + 1] AS state FROM orders) JOIN customer ON o_custkey = c_custkey
 LEFT JOIN (SELECT l_orderkey, [NULL, '', 'in_progress', 'completed', 'blocked', 'nonsense'][min(l_suppkey) % 6 + 1] AS named FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey)""")
def settled_dispatches(spark, d):
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), at(STATES, F.col("o_orderkey") % 9).alias("status"))
    first = read(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("first"))
    replies = first.select("id", at((None, "", "in_progress", "completed", "blocked", "nonsense"), F.col("first") % 6).alias("named"))
    over = read(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("session_id"))
    return D.settle(tasks, replies, over).select("id", "refused", "status")


@query("SELECT id, CASE WHEN stale THEN 'waiting' ELSE status END AS status, CASE WHEN NOT stale THEN claimed_at END AS claimed_at, stale AS recovered FROM (SELECT *, coalesce(status = 'triggered' AND claimed_at <= 1706000000000 - 300000, false) AS stale FROM (SELECT id, CASE status WHEN 'error' THEN 'triggered' ELSE 'waiting' END AS status, CASE WHEN ttft_ms IS NOT NULL THEN started_at END AS claimed_at FROM logs))", "logs")
def recovered_claims(spark, d):
    rows = usage_logs(spark, d).select("id", F.when(F.col("status") == "error", "triggered").otherwise("waiting").alias("status"), F.when(F.col("ttft_ms").isNotNull(), F.col("started_at")).alias("claimed_at"))
    return D.recover_stale(rows, 1_706_000_000_000)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_store_round_trip(spark, d):
    path = sinks.shared_folder(spark, "store")
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)
