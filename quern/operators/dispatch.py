"""States of dispatched tasks: explicit replies, completion without a reply, and claims whose lease ran out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: States that end a task, states a reply may name, states that completion without a reply may follow.
TERMINAL = ("completed", "failed", "cancelled")
REPLIES = ("in_progress", "completed", "blocked")
OPEN = ("pending", "sent", "acknowledged", "in_progress")
#: Milliseconds that a claim holds.
LEASE = 5 * 60 * 1000


def replied(status: Column, named: Column) -> Column:
    """The state after a reply that names ``named`` (null or empty: none); null where the reply is refused."""
    unnamed = F.when(status == "completed_implicit", "completed").when(status.isin("pending", "sent"), "acknowledged").otherwise(status)
    after = F.when(F.coalesce(named, F.lit("")) == "", unnamed).when(named.isin(*REPLIES), named)
    return F.when(~F.coalesce(status.isin(*TERMINAL), F.lit(False)), after)


def ended(status: Column) -> Column:
    """The state once the session of a task has ended; an explicit outcome stays."""
    return F.when(status.isin(*OPEN), "completed_implicit").otherwise(status)


def settle(tasks: DataFrame, replies: DataFrame, ended_sessions: DataFrame, key: str = "id", session: str = "session_id") -> DataFrame:
    """``tasks`` (key, session, status) after the one reply (key, named) each may have, then after the end of sessions; refused tells of a reply that changed nothing by rule."""
    joined = tasks.join(replies.select(key, "named", F.lit(True).alias("__replied")), key, "left")
    joined = joined.join(ended_sessions.select(session).distinct().withColumn("__ended", F.lit(True)), session, "left")
    after = replied(F.col("status"), F.col("named"))
    told = F.when(F.col("__replied"), F.coalesce(after, F.col("status"))).otherwise(F.col("status"))
    refused = F.coalesce(F.col("__replied") & after.isNull() & F.col("status").isNotNull(), F.lit(False))
    return joined.withColumn("refused", refused).withColumn("status", F.when(F.col("__ended"), ended(told)).otherwise(told)).drop("named", "__replied", "__ended")


def recover_stale(df: DataFrame, now: int, lease: int = LEASE) -> DataFrame:
    """Claims (status triggered, claimed_at) older than the lease wait again, without their claim."""
    stale = F.coalesce((F.col("status") == "triggered") & (F.col("claimed_at") <= now - lease), F.lit(False))
    return df.withColumns({"status": F.when(stale, "waiting").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at")), "recovered": stale})
