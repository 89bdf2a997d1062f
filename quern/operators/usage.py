"""Usage analytics over request logs (one row an attempt; times in milliseconds, money in doubles).

All operators are lazy and need one shuffle at most, on group keys after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOUR, DAY = 3_600_000, 86_400_000
UNKNOWN = "(unknown)"


def in_window(start: int, end: int, column: str = "started_at") -> Column:
    """Half open: from ``start`` up to but not at ``end``."""
    return (F.col(column) >= start) & (F.col(column) < end)


def in_closed_range(column: str, start: int | None = None, end: int | None = None) -> Column:
    """Closed at both ends; a bound that is None or not positive is no bound."""
    found = F.lit(True)
    if start and start > 0:
        found &= F.col(column) >= start
    if end and end > 0:
        found &= F.col(column) <= end
    return found


def equal_to(**wanted) -> Column:
    """All given equalities; None adds nothing, a list is an IN."""
    parts = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if v is not None and v != []]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def only_pairs(df: DataFrame, pairs: Iterable[tuple], columns: tuple[str, str], schema: str = "a string, b string") -> DataFrame:
    """Rows whose pair of values is listed, where None in the list means null in the row."""
    listed = df.sparkSession.createDataFrame(list(pairs), schema)
    a, b = listed.columns
    return df.join(F.broadcast(listed), df[columns[0]].eqNullSafe(listed[a]) & df[columns[1]].eqNullSafe(listed[b]), "left_semi")


def status_codes(texts: Iterable[str]) -> list[int]:
    """The numbers among ``texts``; anything else is left out."""
    return [int(t) for t in texts if t.strip().lstrip("+-").isdigit()]


def _tokens(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


TOKENS = ("input_tokens", "billable_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def overview(logs: DataFrame) -> DataFrame:
    """One row. Counts and tokens of nothing are 0, cost and mean duration of nothing stay null."""
    return logs.agg(
        F.count("*").alias("request_count"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("attempt_index") > 1).alias("retry_count"),
        *map(_tokens, TOKENS),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("ttft_ms").alias("avg_ttft_ms"),
    )


def clamp_offset(minutes: int) -> int:
    """A time-zone offset in minutes, within 14 hours either way."""
    return max(-840, min(840, minutes))


def bucket_of(column: str, step: int, offset_minutes: int = 0) -> Column:
    """The start of a time's bucket, with buckets aligned to local time."""
    shift = clamp_offset(offset_minutes) * 60_000
    return F.expr(f"(({column} + {shift}L) div {step}L) * {step}L - {shift}L")


def step_of(start: int, end: int) -> int:
    """Hours for windows up to two days, else days."""
    return HOUR if end - start <= 2 * DAY else DAY


def spine(spark, start: int, end: int, step: int, offset_minutes: int = 0) -> DataFrame:
    """All bucket starts of the half-open window."""
    first = bucket_of(f"{start}L", step, offset_minutes)
    return spark.range(1).select(F.explode(F.sequence(first, F.lit(end - 1), F.lit(step))).alias("bucket_start"))


def buckets(logs: DataFrame, start: int, end: int, step: int, offset_minutes: int = 0, fill: bool = True) -> DataFrame:
    """Counts, tokens and cost of each bucket of the window; with ``fill``, buckets without requests as zeros."""
    found = (
        logs.where(in_window(start, end))
        .groupBy(bucket_of("started_at", step, offset_minutes).alias("bucket_start"))
        .agg(
            F.count("*").alias("request_count"),
            F.count_if(F.col("status") == "error").alias("error_count"),
            F.sum("billable_input_tokens").alias("billable_input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("total_cost_usd").alias("total_cost_usd"),
        )
    )
    if not fill:
        return found
    every = spine(logs.sparkSession, start, end, step, offset_minutes)
    zero = ["request_count", "error_count", "billable_input_tokens", "output_tokens"]
    return every.join(found, "bucket_start", "left").select("bucket_start", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero], "total_cost_usd")


def model_buckets(logs: DataFrame, start: int, end: int, step: int, offset_minutes: int = 0) -> DataFrame:
    """Requests of each provider, model and bucket. A missing name and the literal placeholder are one series, summed."""
    return (
        logs.where(in_window(start, end))
        .groupBy(F.coalesce("provider_id", F.lit(UNKNOWN)).alias("provider_id"), F.coalesce("model_id", F.lit(UNKNOWN)).alias("model_id"), bucket_of("started_at", step, offset_minutes).alias("bucket_start"))
        .agg(F.min("provider_type").alias("provider_type"), F.count("*").alias("request_count"))
    )


def by_model(logs: DataFrame) -> DataFrame:
    """Totals of each provider and model, most requests first; ties by name."""
    return (
        logs.groupBy("provider_id", "model_id")
        .agg(
            F.min("provider_type").alias("provider_type"),
            F.count("*").alias("request_count"),
            F.count_if(F.col("status") == "success").alias("success_count"),
            F.sum("billable_input_tokens").alias("billable_input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("total_cost_usd").alias("total_cost_usd"),
        )
        .orderBy(F.desc("request_count"), F.col("provider_id").asc_nulls_first(), F.col("model_id").asc_nulls_first())
    )


def nearest_rank(df: DataFrame, column: str, rank: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nearest-rank percentile and the maximum of each group."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({rank}) WITHIN GROUP (ORDER BY {column})").alias("percentile"), F.max(column).alias("max"))


def count_by_status(df: DataFrame, statuses: tuple[str, ...], column: str = "status") -> DataFrame:
    """One row a status, absent ones with 0."""
    every = df.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    return F.broadcast(every).join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def distinct_visits(df: DataFrame, identity: tuple[str, ...], time: Column, bots: Column) -> DataFrame:
    """Distinct identities of each hour, and how many rows of bots were left out."""
    hour = F.date_trunc("hour", time)
    return df.agg(
        F.countDistinct(F.when(~bots, F.struct(*identity, hour.alias("hour")))).alias("visits"),
        F.count_if(bots).alias("bot_rows"),
    )


def tri_state(**filters) -> "Column":
    """A filter of each name given: None asks for null, anything else for the value; names that aren't given filter nothing."""
    out = F.lit(True)
    for name, value in filters.items():
        out &= F.col(name).isNull() if value is None else F.coalesce(F.col(name) == value, F.lit(False))
    return out


def assigned_to(name: str, value, unassigned_only: bool) -> "Column":
    """Rows of a value; without one, all rows, or only those without any."""
    if value is not None:
        return tri_state(**{name: value})
    return tri_state(**{name: None}) if unassigned_only else F.lit(True)


def replaced_usage(df: DataFrame, keys: list[str], order: list[str], tokens: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
    """Snapshots merged by replacement: of each field the last known value. A snapshot whose ``tokens`` are all 0 patches the other fields only."""
    counts = F.lit(False)
    for c in tokens:
        counts |= F.col(c) > 0
    at = F.struct(*order)
    last = lambda c, here: F.max_by(F.when(here, F.col(c)), F.when(here & F.col(c).isNotNull(), at)).alias(c)
    out = df.groupBy(*keys).agg(*[last(c, counts) for c in tokens], *[last(c, F.lit(True)) for c in others])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in tokens})
