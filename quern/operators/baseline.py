"""Web-log counts that outlive the logs: a baseline of folded days, the recent days on top, and the same from a stream.

The baseline holds, by metric, the sum of all days up to ``as_of``. The last ``keep`` days are counted anew from the logs each
time. A day that leaves this window is folded into the baseline once: ``as_of`` and the sums change in one version of a store, so
a second run, or a second runner, folds nothing twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators.files import counted_requests, web_log_counts
from quern.sources.store import Change, Conflict, Store

KEEP = 3


class WebLogBaseline:
    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP):
        self.spark, self.store, self.keep = spark, Store(spark, folder), max(1, keep)

    def as_of(self, version=None) -> dt.date | None:
        """The last day that is folded."""
        held = (version or self.store.version()).numbers.get("as_of")
        return dt.date.fromordinal(held) if held else None

    def fold(self, lines: DataFrame, today: dt.date) -> None:
        """Put the days after ``as_of`` and before the window into the baseline. ``lines``: log, line; all that the logs still hold."""
        version = self.store.version()
        as_of, cut = self.as_of(version), today - dt.timedelta(days=self.keep - 1)
        last = cut - dt.timedelta(days=1)
        if as_of and as_of >= last:
            return
        days = web_log_counts(lines).where((F.col("day") <= F.lit(last)) & (F.col("day") > F.lit(as_of) if as_of else F.lit(True)))
        sums = days.groupBy("metric").agg(F.sum("n").alias("n"), F.count("*").alias("days"))
        if version.number:
            sums = sums.unionByName(self.store.read("baseline", version)).groupBy("metric").agg(F.sum("n").alias("n"), F.sum("days").alias("days"))
        try:
            self.store.commit({"baseline": Change(sums, replace=True)}, since=version, numbers=lambda old, rows: {"as_of": last.toordinal()})
        except Conflict:  # another runner has folded meanwhile
            self.fold(lines, today)

    def recent(self, lines: DataFrame, today: dt.date) -> DataFrame:
        """(day, metric, n, filtered_bots) of the window; days that are folded are never counted again."""
        as_of, cut = self.as_of(), today - dt.timedelta(days=self.keep - 1)
        first = max(cut, as_of + dt.timedelta(days=1)) if as_of else cut
        return web_log_counts(lines).where(F.col("day").between(F.lit(first), F.lit(today)))

    def summary(self, lines: DataFrame, today: dt.date) -> DataFrame:
        """(metric, n, days): the baseline and the recent days. Folds first."""
        self.fold(lines, today)
        sums = self.recent(lines, today).groupBy("metric").agg(F.sum("n").alias("n"), F.count("*").alias("days"))
        return sums.unionByName(self.store.read("baseline")).groupBy("metric").agg(F.sum("n").alias("n"), F.sum("days").alias("days"))


def follow(lines: DataFrame, folder: str, checkpoint: str, late: str = "2 hours"):
    """Start to count a stream of lines (log, line) into the table ``days`` of a store; ``streamed_days`` reads it.

    What counts once an hour is dropped by state that a watermark bounds: lines that come later than ``late`` may count again.
    A micro-batch adds its counts in one version that also holds its number, so a batch that is run again changes nothing.
    """
    rows = counted_requests(lines).withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    people = rows.where("NOT robot").dropDuplicatesWithinWatermark(["metric", "hour", "ip", "agent", "file"])
    return people.unionByName(rows.where("robot")).writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, folder)).option("checkpointLocation", checkpoint)


def add_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Add one micro-batch's counts, unless its number is already in."""
    store = Store(batch.sparkSession, folder)
    version = store.version()
    if version.numbers.get("batch", -1) >= number:
        return
    counts = batch.groupBy(F.col("hour").cast("date").alias("day"), "metric").agg(F.count_if(~F.col("robot")).alias("n"), F.count_if("robot").alias("filtered_bots"))
    store.commit({"days": Change(counts)}, reads=["days"], since=version, numbers=lambda old, rows: {"batch": number})


def streamed_days(spark: SparkSession, folder: str) -> DataFrame:
    return Store(spark, folder).read("days").groupBy("day", "metric").agg(F.sum("n").alias("n"), F.sum("filtered_bots").alias("filtered_bots"))
