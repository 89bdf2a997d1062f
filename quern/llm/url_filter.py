"""URL filters by hashed expressions, DataFrame functions only.

A rule is (action, host, path). It fits a URL whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path. Each distinct (host, path) is expanded into host-suffix x path-prefix expressions (suffixes of as many
labels and prefixes of as many characters as rules have, so a host of any length gives a few); an expression meets the rules
by a 32-bit prefix of its SHA-256 (an equi-join), a hit counts only if the full digests agree, and the longest rule wins.

Defined results
* url null or without "://": host and path are empty; the empty expression fits only a rule with empty host and path.
* no rule fits: rule is null and the verdict is ``default``.
* ties: by length of host+path, then longer host, then the expression, then "allow" before "block"; a rule given twice
  counts once; rows with a null host, path or action are no rules.
* empty tables give empty results; repeated rows are all kept; only ``url_col`` is read, and the result columns replace
  columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query (fixed values).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
PREFIX_BITS = 32
#: A rule set up to this many bytes is sent to every executor; a larger one is joined by a shuffle, with the same result.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_BITS // 4)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    listed = (
        rules.select("action", "host", "path")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
        .withColumn("rule_host", F.translate("host", UPPER, LOWER))
        .groupBy("rule_host", F.col("path").alias("rule_path"))
        .agg(F.min("action").alias("rule_action"))
        .withColumn("rule_text", F.concat("rule_host", "rule_path"))
        # Host and path are kept apart in the hashed text, so "a.b" + "/c" and "a.b/c" + "" stay two expressions.
        .withColumn("rule_digest", _digest(F.concat_ws("\u0000", "rule_host", "rule_path")))
        .withColumn("rule_short", _short(F.col("rule_digest")))
    )
    # One row: the lengths of path and the numbers of host labels that rules have, at most those of the longest rule.
    dots = F.length("rule_host") - F.length(F.replace("rule_host", F.lit(".")))
    size = F.sum(F.octet_length("rule_text") + F.lit(200))
    shape = listed.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.collect_set(dots + 1).alias("labels"), F.count("*").alias("n"), size.alias("bytes")).first()
    lengths, labels, count = sorted(shape["lengths"]), sorted(shape["labels"]), shape["n"]
    out = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not count:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = listed.drop("rule_host")
    if shape["bytes"] <= BROADCAST_BYTES:
        listed = F.broadcast(listed)

    # Work on distinct (host, path): a URL that fills a third of the table is expanded once.
    sites = pages.select(host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p")).distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("h", ".", -n) for n in labels]))
    prefixes = F.filter(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths]), lambda x: x.isNotNull())
    wide = (
        sites.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.concat_ws("\u0000", "suffix", "prefix")))
    )
    order = F.struct(
        F.length("rule_text").alias("n"),
        F.length("suffix").alias("m"),
        F.col("rule_text").alias("t"),
        F.col("rule_action").alias("a"),
    )
    best = (
        wide.join(listed, (_short(F.col("digest")) == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest")))
        .groupBy("h", "p")
        .agg(F.max(order).alias("best"))
        .select("h", "p", F.col("best.t").alias("rule"), F.col("best.a").alias("found"))
    )
    base = out.drop("rule", "verdict").alias("pages")
    names = [c.replace("`", "``") for c in base.columns]
    same = (F.col("pages.host") == F.col("best.h")) & (F.col("pages.path") == F.col("best.p"))
    kept = [F.col(f"pages.`{c}`") for c in names]
    return base.join(best.alias("best"), same, "left").select(*kept, F.col("best.rule").alias("rule"), F.coalesce(F.col("best.found"), F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
WITH rules(action, rhost, rpath) AS (VALUES {values}),
parts AS (
  SELECT page_id,
         CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
              ELSE translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') END AS host,
         CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
              ELSE regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') END AS path
  FROM pages),
sites AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(action, length(rhost || rpath)) AS action
  FROM sites JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, parts.host AS host, parts.path AS path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {"op4_url_filter": _sql()}
