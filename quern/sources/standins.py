"""Tables of the operational data model, derived from the driver's tables, as Spark frames and as DuckDB SQL.

The driver has no usage log, messages or notes; these views give its tables the shapes that the operators work on.
Every view is a projection, so pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_USAGE = """
  CAST(event_id AS STRING) AS id, concat('s', user_id % 20) AS session_id,
  CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN '(unknown)' ELSE concat('p', user_id % 5) END AS provider_id,
  concat('t', user_id % 2) AS provider_type,
  CASE WHEN user_id % 17 = 0 THEN NULL ELSE event_type END AS model_id,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CAST(CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 429 WHEN event_type = 'error' AND k % 3 = 1 THEN 503 ELSE NULL END AS INT) AS http_status_code,
  CAST(k % 3 + 1 AS INT) AS attempt_index,
  k * 20 AS input_tokens, k * 3 AS output_tokens, k * 5 % 301 AS cache_read_tokens, k % 41 AS cache_creation_tokens, k % 7 AS reasoning_tokens,
  greatest(0, k * 20 - k * 5 % 301 - k % 41) AS billable_input_tokens,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS total_cost_usd,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k * 3 END AS ttft_ms,
  started_at, user_id, event_type
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each request attempt; times in milliseconds."""
    rows = read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "unix_millis(CAST(ts AS TIMESTAMP)) AS started_at"
    )
    return rows.selectExpr(*_split(_USAGE))


def _split(columns: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, word = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of sessions; created_at in milliseconds grows with the turn, and every fifth user row carries a compaction summary."""
    return read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("id"),
        F.col("conv_id").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), F.lit('{"compactSummary":true}')).alias("meta"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 86_400_00 + F.col("turn") * 60_000).alias("created_at"),
        F.col("turn").cast("int").alias("sort_order"),
    )


def memory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes; times in seconds."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("scope"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.element_at(F.array(F.lit("ephemeral"), F.lit("standard"), F.lit("lasting")), (F.col("doc_id") % 3 + 1).cast("int")).alias("priority"),
        F.element_at(F.array(*map(F.lit, ("active", "active", "warm", "cold", "deprecated"))), (F.col("doc_id") % 5 + 1).cast("int")).alias("status"),
        (F.lit(1_700_000_000) - (F.col("doc_id") * 7919 % 200) * 86_400).alias("updated_at"),
        (F.lit(1_690_000_000) + F.col("doc_id")).alias("created_at"),
    )


#: The same views for DuckDB, to be put behind WITH.
USAGE_SQL = f"""raw_logs AS (
  SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS started_at FROM events),
logs AS (SELECT {_USAGE} FROM raw_logs)"""

MESSAGES_SQL = """messages AS (
  SELECT concat_ws('-', conv_id, turn) AS id, conv_id AS session_id, role, text AS content,
         CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN '{"compactSummary":true}' END AS meta,
         1700000000000 + conv_id * 8640000 + turn * 60000 AS created_at, CAST(turn AS INT) AS sort_order
  FROM conversations)"""

MEMORY_SQL = """memory AS (
  SELECT doc_id AS id, source AS scope, substring(text, 1, 80) AS title, text AS content,
         CASE doc_id % 3 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'standard' ELSE 'lasting' END AS priority,
         CASE doc_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'active' WHEN 2 THEN 'warm' WHEN 3 THEN 'cold' ELSE 'deprecated' END AS status,
         1700000000 - (doc_id * 7919 % 200) * 86400 AS updated_at, 1690000000 + doc_id AS created_at
  FROM documents)"""
