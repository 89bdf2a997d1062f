"""Joins of the operational model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, into: str) -> DataFrame:
    """Parents with the number of their children, 0 without any: one aggregate and one join for all parents."""
    counts = children.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias(into))
    return parents.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(into, F.coalesce(into, F.lit(0)))


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], into: str) -> DataFrame:
    """Parents with their children as an ordered array; null without any."""
    row = F.struct(*order, *[c for c in children.columns if c not in (*order, child_key)])
    arrays = children.groupBy(F.col(child_key).alias("__k")).agg(F.sort_array(F.collect_list(row)).alias(into))
    return parents.join(arrays, F.col(key) == F.col("__k"), "left").drop("__k")


def superseded(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with a later row under the same key: all but the last, by one window instead of a theta join."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("__n > 1").drop("__n")


def paired(calls: DataFrame, results: DataFrame, keys: list[str], missing: dict[str, object]) -> DataFrame:
    """Every call with its result, and a placeholder where there is none."""
    joined = calls.join(results, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in missing.items()})


def lookup_first(rows: DataFrame, catalog: DataFrame, array: str, key: str, value: str, on: str, into: str) -> DataFrame:
    """A value of the first entry of a nested array whose key fits (catalog rows in order of their position column)."""
    flat = catalog.select("position", F.posexplode(array).alias("__i", "__e")).select("position", "__i", F.col(f"__e.{key}").alias("__k"), F.col(f"__e.{value}").alias("__v"))
    first = flat.groupBy("__k").agg(F.min_by("__v", F.struct("position", "__i")).alias(into))
    return rows.join(first, F.col(on) == F.col("__k"), "left").drop("__k")
