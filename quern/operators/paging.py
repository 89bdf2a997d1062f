"""Sorted pages: by offset with a total, and by key. Every page is a top-k, never a full sort of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Largest and usual page sizes of the endpoints (fixed values).
LIMITS = {"usage": (500, 50), "timeline": (500, 100), "memory": (500, 50), "search": (50, 10), "content_search": (200, 50), "cron": (200, 50), "goals": (100, 20), "turns": (50, 10), "messages": (5000, 200)}


def clamp(limit: int | None, kind: str) -> int:
    most, usual = LIMITS[kind]
    return max(1, min(most, usual if limit is None else limit))


def page(df: DataFrame, order: list, limit: int, offset: int = 0, total: str | None = "total") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in ``order``; with ``total``, the number of all rows under the same filter."""
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias(total)))) if total else rows


def before(keys: list[tuple[str, str]], cursor: list) -> Column:
    """Rows after ``cursor`` in the order of ``keys``: (column, "asc" or "desc"), compared from the first on."""
    parts = []
    for i, (name, way) in enumerate(keys):
        same = [F.col(k) == F.lit(v) for (k, _), v in zip(keys[:i], cursor)]
        step = F.col(name) > F.lit(cursor[i]) if way == "asc" else F.col(name) < F.lit(cursor[i])
        parts.append(reduce(lambda a, b: a & b, [*same, step]))
    return reduce(lambda a, b: a | b, parts)


def keyset(df: DataFrame, keys: list[tuple[str, str]], limit: int, cursor: list | None = None) -> DataFrame:
    """The next ``limit`` rows and whether more follow (has_more): one row more is read to know."""
    rows = df.where(before(keys, cursor)) if cursor else df
    order = [F.col(k).asc() if way == "asc" else F.col(k).desc() for k, way in keys]
    taken = rows.orderBy(*order).limit(limit + 1)
    # The page is at most limit + 1 rows, so counting and numbering it takes one small task.
    from pyspark.sql import Window as W

    every = W.partitionBy()
    numbered = taken.withColumn("__n", F.row_number().over(W.orderBy(*order))).withColumn("has_more", F.count("*").over(every) > limit)
    return numbered.where(F.col("__n") <= limit).drop("__n")


def ranked(column: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in ``order``, values not listed last: for sorting by a fixed ranking."""
    out = F.lit(len(order))
    for i, v in enumerate(order):
        out = F.when(column == v, i).otherwise(out)
    return out


def natural_key(name: Column) -> Column:
    """A sort key by which numbers in names count by value, of any length, and neither case nor accents count (a collation; equal names are equal keys)."""
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    # A number is told by the length of its digits, then by these.
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    by_value = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p))
    return F.collate(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), by_value(p)).otherwise(p)), ""), "UNICODE_CI_AI")
