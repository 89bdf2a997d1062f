"""Mutations as pure functions from old and new rows to the next table: write the result over a partition to commit it.

Spark has no compare-and-set and no transaction over tables; ``claim`` and ``commit`` give the deterministic outcome that
such an update would have if all requests came at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _one_each(new: DataFrame, keys: list[str], order: list) -> DataFrame:
    return new.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of new rows alike in key the last in ``order`` does (without it, keys of ``new`` must differ)."""
    new = _one_each(new, keys, [F.desc(c) for c in order]) if order else new
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows whose key is not there yet; of new rows alike in key the first in ``order`` (without it, keys of ``new`` must differ)."""
    new = _one_each(new, keys, order) if order else new
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti"))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Parents named in ``new`` lose their children and get the new ones."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def claim(df: DataFrame, due: Column, free: Column, keys: list[str], order: list[str]) -> DataFrame:
    """The one due and free row of each key that a claim gets."""
    return df.where(due & free).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def counters(deltas: DataFrame, keys: list[str], delta: str, time: str) -> DataFrame:
    """Counters kept as appended deltas, summed on reading."""
    return deltas.groupBy(*keys).agg(F.sum(delta).alias("revision"), F.max(time).alias("at"))


def finalize_orphans(df: DataFrame, live: DataFrame, key: str, running: Column, into: str) -> DataFrame:
    """Running rows whose key is not alive get the status ``into`` on reading."""
    marked = df.join(live.select(F.col(key).alias("__live")).distinct(), F.col(key) == F.col("__live"), "left")
    return marked.withColumn("status", F.when(running & F.col("__live").isNull(), into).otherwise(F.col("status"))).drop("__live")


def verify_copy(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows a copy changed (null-safe on every field), missed or added."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    rest = [c for c in old.columns if c not in keys]
    differs = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in rest], F.lit(False))
    here, there = F.col(f"a.{keys[0]}").isNotNull(), F.col(f"b.{keys[0]}").isNotNull()
    counts = joined.agg(F.count_if(here & there & differs).alias("changed"), F.count_if(here & ~there).alias("missing"), F.count_if(~here & there).alias("added"))
    return counts.unpivot([], ["changed", "missing", "added"], "kind", "n")


def commit(df: DataFrame, time: str, newest: str, expected: str, revision: str) -> DataFrame:
    """Snapshots with their time moved beyond the newest message, and whether the revision they expect is still the current one."""
    return df.withColumn(time, F.greatest(F.col(time), F.col(newest) + 1)).withColumn("committed", F.col(expected) == F.col(revision))


def union_first(frames: list[DataFrame], keys: list[str], order: list[str], number: str = "query_no") -> DataFrame:
    """The rows of all frames, of each key the one from the first frame that has it."""
    every = reduce(lambda a, b: a.unionByName(b), [f.withColumn(number, F.lit(i)) for i, f in enumerate(frames)])
    return every.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(number, *order))).where("__n = 1").drop("__n")


def splice(old: DataFrame, new: DataFrame, keys: list[str], position: str, anchor: Column, artifact: Column) -> DataFrame:
    """Rows of ``old`` before the anchor and of ``new`` from it on, without artifacts; only keys that have an anchor."""
    at = new.where(anchor).groupBy(*keys).agg(F.min(position).alias("__at"))
    head = old.join(at, keys).where(F.col(position) < F.col("__at")).withColumn("side", F.lit("old"))
    tail = new.join(at, keys).where((F.col(position) >= F.col("__at")) & ~artifact).withColumn("side", F.lit("new"))
    return head.unionByName(tail).drop("__at")
