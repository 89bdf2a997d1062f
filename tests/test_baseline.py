"""The cumulative baseline of web-log counts: reruns, missed days, and a stream against the batch."""

import datetime as dt
import random

from quern.operators.baseline import WebLogBaseline, add_batch, follow, streamed_days
from quern.operators.files import counted_requests, web_log_counts


def lines(seed, days, n):
    r = random.Random(seed)
    for _ in range(n):
        t = dt.datetime(2026, 3, 1) + dt.timedelta(days=r.randrange(days), hours=r.randrange(3), minutes=r.randrange(60))
        agent = r.choice(["Mozilla", "Mozilla", "bot/1", "-", "electron-updater"])
        log, target = r.choice([("access", "/"), ("access", "/x.png"), ("clicks", f"/go?f={r.randrange(2)}"), ("downloads", "/downloads/a.exe")])
        yield (log, f'9.9.9.{r.randrange(3)} - - [{t:%d/%b/%Y:%H:%M:%S} +0000] "GET {target} HTTP/1.1" 200 1 "-" "{agent}"', t)


def frame(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "log string, line string")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_folding_again_changes_nothing_and_rotated_logs_stay_counted(spark, tmp_path):
    every = list(lines(1, 10, 400))
    day = lambda n: dt.date(2026, 3, n)
    kept = WebLogBaseline(spark, str(tmp_path), keep=3)
    whole = {}
    for r in web_log_counts(frame(spark, every)).collect():
        n, days = whole.get(r.metric, (0, 0))
        whole[r.metric] = (n + r.n, days + 1)
    kept.fold(frame(spark, every), day(4))
    assert kept.as_of() == day(1)
    kept.fold(frame(spark, every), day(4))
    assert kept.store.latest() == 1
    # A runner that lags, then one that comes days later, when the logs of the folded days are gone.
    kept.fold(frame(spark, every), day(3))
    late = [r for r in every if r[2].date() > day(1)]
    got = {r.metric: (r.n, r.days) for r in kept.summary(frame(spark, late), day(10)).collect()}
    assert got == whole and kept.as_of() == day(7)
    wide = WebLogBaseline(spark, str(tmp_path), keep=9)  # a larger window must not count folded days again
    assert {r.metric: (r.n, r.days) for r in wide.summary(frame(spark, late), day(10)).collect()} == whole


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    batch = counted_requests(frame(spark, list(lines(2, 1, 50))))
    add_batch(batch, 0, str(tmp_path))
    once = rows_of(streamed_days(spark, str(tmp_path)))
    add_batch(batch, 0, str(tmp_path))
    assert rows_of(streamed_days(spark, str(tmp_path))) == once
    add_batch(batch, 1, str(tmp_path))
    assert sum(r[2] for r in rows_of(streamed_days(spark, str(tmp_path)))) == 2 * sum(r[2] for r in once)


def test_stream_equals_batch(spark, tmp_path):
    every = sorted(lines(3, 2, 160), key=lambda r: r[2])
    for i in range(0, 160, 40):
        frame(spark, every[i : i + 40]).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("log string, line string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for _ in range(2):  # started twice: the second finds nothing new
        follow(stream, f"{tmp_path}/kept", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert rows_of(streamed_days(spark, f"{tmp_path}/kept")) == rows_of(web_log_counts(frame(spark, every)))
