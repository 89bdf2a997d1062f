"""Files, logs and dispatched tasks: the cases that the tables don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators import dispatch as D, files as O, merge


def test_only_real_daily_names_expire(spark):
    names = ["2024-02-28.log", "2024-02-29.log", "2024-03-01.log", "2024-02-30.log", "2023-02-29.log", "x2024-01-01.log", "2024-01-01.log.gz", "2024-1-1.log", "2024-01-01.log\n", None]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    kept = lambda days: sorted(r.name for r in O.expired_daily_files(files, "name", dt.date(2024, 3, 1), days).collect())
    assert kept(1) == ["2024-02-28.log", "2024-02-29.log"]  # today is the first day
    assert kept(2) == ["2024-02-28.log"]
    assert kept(0) == kept(1) == kept(1.9) and kept(10**6) == []


def test_web_log_counts(spark):
    line = lambda ip, at, target, agent: f'{ip} - - [{at} +0000] "GET {target} HTTP/1.1" 206 5 "-" "{agent}"'
    rows = [("downloads", line("a", f"01/Mar/2024:10:0{k}:00", "/downloads/x.exe", "Mozilla")) for k in range(5)]  # ranges of one file
    rows += [("downloads", line("a", "01/Mar/2024:11:00:00", "/downloads/x.exe", "Mozilla")), ("downloads", line("b", "01/Mar/2024:10:00:00", "/downloads/x.exe", "electron-builder"))]
    rows += [("downloads", line("b", "01/Mar/2024:10:00:00", "/downloads/latest.yml", "Mozilla")), ("access", line("a", "02/Mar/2024:10:00:00", "/?q=1", "CURL/8")), ("access", line("a", "02/Mar/2024:10:00:00", "/", ""))]
    rows += [("access", line("a", "99/Mar/2024:10:00:00", "/", "Mozilla")), ("access", "nonsense"), ("access", None)]
    got = {(str(r.day), r.metric): (r.n, r.filtered_bots) for r in O.web_log_counts(spark.createDataFrame(rows, "log string, line string")).collect()}
    assert got == {("2024-03-01", "web_download_local"): (2, 0), ("2024-03-01", "app_update"): (1, 0), ("2024-03-02", "page_view"): (0, 2)}


def test_find_files(spark):
    rows = [("/a/Report one.PDF", "Report one.PDF", "PDF", 5, 3, False), ("/b/report", "report", "", 0, 9, True), ("/c/one.png", "one.png", "png", 7, 9, False)]
    index = spark.createDataFrame(rows, "path string, name string, extension string, size long, modified long, is_folder boolean")
    found = lambda *a, **k: [r.path for r in O.find_files(index, *a, **k).collect()]
    assert found("  ") == found(None) == found("", "nonsense") == []
    assert found("one report") == ["/a/Report one.PDF"] and found("", "folder") == ["/b/report"]
    assert found("<ext:png;pdf>") == ["/c/one.png", "/a/Report one.PDF"] and found("report folder:") == ["/b/report"]
    assert found("o", sort="nonsense", descending=False) == ["/b/report", "/c/one.png", "/a/Report one.PDF"]  # newest first, ties by path
    assert found("o", sort="size", size=-1, offset=-3) == ["/c/one.png", "/a/Report one.PDF", "/b/report"]
    assert found("o", size=1, offset=1) == ["/c/one.png"]


@pytest.mark.parametrize(
    "before, after, shown",
    [
        ((True, None, "a\r\n", None), (True, None, "a\n", None), False),
        ((True, "h", "a", None), (True, "h", "b", None), False),
        ((True, "h", None, None), (True, None, None, None), True),
        ((True, None, None, "p"), (True, "h", "p", None), False),
        ((True, None, "", None), (True, None, None, None), False),
        ((False, None, "a", None), (False, None, "b", None), False),
        ((False, None, None, None), (True, None, None, None), True),
    ],
)
def test_changes_worth_showing(spark, before, after, shown):
    side = "struct<exists: boolean, hash: string, text: string, preview: string>"
    df = spark.createDataFrame([(before, after)], f"before {side}, after {side}")
    assert df.select(O.worth_showing("before", "after").alias("x")).first().x is shown


def test_replies_and_ends(spark):
    cases = [("completed_implicit", None, "completed"), ("completed_implicit", "blocked", "blocked"), ("sent", "", "acknowledged"), ("in_progress", None, "in_progress")]
    cases += [("completed", "in_progress", None), ("cancelled", None, None), ("pending", "failed", None), ("blocked", "completed", "completed"), (None, "blocked", "blocked")]
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "status string, named string, want string, i int")
    assert all(r.got == r.want for r in rows.select("want", D.replied(F.col("status"), F.col("named")).alias("got")).collect())
    tasks = spark.createDataFrame([(1, 1, "sent"), (2, 1, "sent"), (3, 1, "failed"), (4, 2, "sent"), (5, None, "sent")], "id long, session_id long, status string")
    replies = spark.createDataFrame([(1, "blocked"), (3, "completed"), (4, "nonsense")], "id long, named string")
    got = {r.id: (r.status, r.refused) for r in D.settle(tasks, replies, spark.createDataFrame([(1,), (1,)], "session_id long")).collect()}
    assert got == {1: ("blocked", False), 2: ("completed_implicit", False), 3: ("failed", True), 4: ("sent", True), 5: ("sent", False)}


def test_stale_claims_wait_again(spark):
    rows = spark.createDataFrame([(1, "triggered", 100), (2, "triggered", 101), (3, "triggered", None), (4, "waiting", 0), (5, None, 0)], "id long, status string, claimed_at long")
    got = {r.id: (r.status, r.claimed_at, r.recovered) for r in D.recover_stale(rows, D.LEASE + 100).collect()}
    assert got == {1: ("waiting", None, True), 2: ("triggered", 101, False), 3: ("triggered", None, False), 4: ("waiting", 0, False), 5: (None, 0, False)}


def test_repeated_keys_of_new_rows(spark):
    base = spark.createDataFrame([(1, "old", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 5), (2, "e", 4)], "k long, v string, at long")
    assert sorted((r.k, r.v) for r in merge.upsert(base, new, ["k"], ["at"]).collect()) == [(1, "c"), (2, "d")]
    assert sorted((r.k, r.v) for r in merge.insert_absent(base, new, ["k"], ["at"]).collect()) == [(1, "old"), (2, "e")]
