"""Queries over kept structures: tables that change together, identities, the gram index. They write while they are built."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import search as K
from quern.operators.index import GramIndex
from quern.plans.kit import Catalog
from quern.sources.sinks import shared_folder
from quern.sources.standins import memory_entries, read
from quern.sources.store import Change, Conflict, Store

C = Catalog()
query, QUERIES, ORACLE_SQL = C.query, C.queries, C.sql


_RANKED = """, held AS (SELECT * EXCLUDE (title), CASE WHEN priority = 'lasting' THEN title ELSE 'a draft' END AS title FROM memory),
 counted AS (SELECT *, (length(both_) - length(replace(both_, 'worthless', ''))) / 9 AS tf0, (length(both_) - length(replace(both_, 'clown', ''))) / 5 AS tf1, greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) AS len FROM (SELECT *, lower(title || chr(10) || chr(10) || chr(10) || content) AS both_ FROM held)),
 stats AS (SELECT count(*) AS n, avg(len) AS avg_len, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM counted)
 SELECT id, round(score, 9) AS score, 'rank' AS channel FROM (SELECT c.*, greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / avg_len)) + greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score FROM counted c, stats
 WHERE tf0 > 0 AND tf1 > 0 AND status IN ('active', 'warm')) ORDER BY status <> 'active', score DESC, updated_at DESC, id LIMIT 20"""


@query(_RANKED, "memory")
def search_by_index(spark, d):
    """Notes are indexed as drafts; the lasting ones then get their titles, and only these are indexed again."""
    notes = memory_entries(spark, d)
    held = notes.withColumn("title", F.when(F.col("priority") == "lasting", F.col("title")).otherwise("a draft"))
    index = GramIndex(spark, shared_folder(spark, "notes"))
    index.upsert(notes.withColumn("title", F.lit("a draft")))
    index.upsert(held.where("priority = 'lasting'"))
    return K.search(held, "worthless CLOWN", 20, index=index).select("id", F.round("score", 9).alias("score"), "channel")


@query("SELECT o_custkey AS custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, count(*) AS counted FROM orders GROUP BY 1")
def tables_of_one_version(spark, d):
    """Orders and the counts of customers change together; a writer that saw the first version only is refused."""
    store, orders = Store(spark, shared_folder(spark, "orders")), read(spark, d, "orders")
    counts = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("counted"))
    open_ = orders.where("o_orderstatus = 'O'")
    first = store.commit({"orders": Change(open_), "counts": Change(counts(open_))})
    rest = orders.where("o_orderstatus <> 'O'")
    store.commit({"orders": Change(rest), "counts": Change(counts(store.read("orders", first).unionByName(rest)), replace=True)}, reads=["orders"], since=first)
    try:
        store.commit({"counts": Change(counts(open_), replace=True)}, since=first)
    except Conflict:
        pass
    now = store.version()
    sums = store.read("orders", now).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("total"))
    return sums.join(store.read("counts", now), "o_custkey").select(F.col("o_custkey").alias("custkey"), "orders", "total", "counted")


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) AS ids, min(o_orderkey) AS least_key FROM orders GROUP BY 1")
def appended_identities(spark, d):
    """A batch for each status, appended one after the other; every row gets a number of its own and keeps it."""
    store, orders = Store(spark, shared_folder(spark, "numbered")), read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    batches = [store.append("orders", orders.where(F.col("o_orderstatus") == s), "number") for s in ("F", "O", "P")]
    given = batches[0].unionByName(batches[1]).unionByName(batches[2])
    kept = store.read("orders").select(F.col("o_orderkey").alias("key"), F.col("number").alias("__number"))
    same = given.join(kept, (F.col("o_orderkey") == F.col("key")) & (F.col("number") == F.col("__number")))
    return same.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("number").alias("ids"), F.min("o_orderkey").alias("least_key"))
