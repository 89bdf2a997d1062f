"""The store of several tables under races, identities, and the gram index against scans."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import search
from quern.operators.index import GramIndex, bucket_of, gram_codes, packed, unpacked
from quern.sources.store import Change, Conflict, Store


def test_two_writers_race_and_readers_see_whole_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"a": Change(spark.range(1)), "b": Change(spark.range(1))})
    since, done, seen, stop = store.version(), [], [], threading.Event()

    def write(n):
        own = Store(spark, f"file://{tmp_path}/s")
        try:
            own.commit({"a": Change(spark.range(n), replace=True), "b": Change(spark.range(n), replace=True)}, since=since)
            done.append(n)
        except Conflict:
            done.append(None)

    def look():
        while not stop.is_set():
            v = store.version()
            seen.append((store.read("a", v).count(), store.read("b", v).count()))

    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 5)]
    reader = threading.Thread(target=look)
    for t in (*threads, reader):
        t.start()
    for t in threads:
        t.join()
    stop.set()
    reader.join()
    assert done.count(None) == 1 and store.latest() == 2
    won = next(n for n in done if n)
    assert store.read("a").count() == store.read("b").count() == won
    assert all(a == b for a, b in seen)
    assert len(list((tmp_path / "s/data/a").iterdir())) == 2  # the loser's folder is gone


def test_appends_get_past_each_other_and_reads_conflict(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = store.commit({"log": Change(spark.range(2))}, numbers=lambda old, rows: {"n": old.get("n", 0) + rows["log"].count()})
    add = lambda old, rows: {"n": old["n"] + rows["log"].count()}
    store.commit({"log": Change(spark.range(3))}, since=first, numbers=add)
    made = store.commit({"log": Change(spark.range(4))}, since=first, numbers=add)
    assert made.number == 3 and made.numbers == {"n": 9} and store.read("log").count() == 9
    with pytest.raises(Conflict):
        store.commit({"other": Change(spark.range(1))}, reads=["log"], since=first)
    assert store.read("log", first).count() == 2
    store.forget()
    assert store.read("log").count() == 9 and store.latest() == 3


def test_identities_are_consecutive_over_racing_appends(spark, tmp_path):
    store, given = Store(spark, str(tmp_path)), []

    def write(n):
        own = Store(spark, str(tmp_path))
        given.append({r.x: r.number for r in own.append("t", spark.range(n).withColumn("x", F.col("id") + n * 1000).repartition(3), "number").collect()})

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7, 0)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    numbers = [n for g in given for n in g.values()]
    assert sorted(numbers) == list(range(12))
    assert {r.x: r.number for r in store.read("t").collect()} == {k: v for g in given for k, v in g.items()}


def test_partitioned_folders_of_several_versions_are_one_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(3):
        store.commit({"t": Change(spark.range(6).selectExpr("id", "id % 2 AS k"), by=("k",))})
    rows = store.read("t")
    assert rows.columns == ["id", "k"] and rows.where("k = 1").count() == 9
    assert "PartitionFilters: [isnotnull(k" in rows.where("k = 1")._jdf.queryExecution().toString()


def test_lists_come_back(spark):
    r = random.Random(1)
    for span in (3, 300, 70_000, 1 << 40):
        ids = sorted(r.sample(range(-span, span * 5), 7))
        width, steps = packed(search.GramIndex and __import__("numpy").array(ids))
        assert unpacked(ids[0], width, steps).tolist() == ids
    assert len(gram_codes("ab")) == 0 and len(gram_codes("añ😀b")) == 2 and bucket_of(gram_codes("hello")).max() < 32


SCHEMA = "id long, scope string, title string, content string, status string, updated_at long"


def notes(seed, ids):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randrange(1, 9)))
    return [(i, r.choice("pq"), None if r.random() < 0.05 else word(), None if r.random() < 0.05 else " ".join(word() for _ in range(r.randrange(30))), r.choice(["active", "warm", "cold"]), r.randrange(100)) for i in ids]


def same(spark, rows, index, queries, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    for q in queries:
        a = [(r.id, round(r.score, 9), r.channel) for r in search.search(df, q, 50, **options).collect()]
        b = [(r.id, round(r.score, 9), r.channel) for r in search.search(df, q, 50, index=index, **options).collect()]
        assert a == b, q


def test_index_equals_scan_through_updates_and_deletes(spark, tmp_path):
    index = GramIndex(spark, str(tmp_path), buckets=4, chunk=16)
    rows = {r[0]: r for r in notes(1, range(120))}
    index.upsert(spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3))
    queries = ["aab", "ÉBA abb", "abab", "aaa bbb", "éééé", "bab aba"]
    same(spark, list(rows.values()), index, queries)
    new = notes(2, [*range(40, 70), *range(500, 520)])
    rows.update({r[0]: r for r in new})
    index.upsert(spark.createDataFrame(new, SCHEMA))
    index.delete(spark.createDataFrame([(3,), (45,), (999,)], "id long"))
    rows = {i: r for i, r in rows.items() if i not in (3, 45)}
    version = index.store.version()
    assert version.numbers == {"entries": len(rows), "length": sum(max(0, len(t or "") - 2) for r in rows.values() for t in r[2:4])}
    same(spark, list(rows.values()), index, queries[:3])
    same(spark, list(rows.values()), index, ["abb", "ab"], statuses=None, scope="p", start=20, end=80)
    assert search.search(spark.createDataFrame(list(rows.values()), SCHEMA), "zzzz", index=index).collect() == []


def test_search_reads_the_lists_of_its_grams_only(spark, tmp_path):
    index = GramIndex(spark, str(tmp_path))
    index.upsert(spark.createDataFrame(notes(3, range(50)), SCHEMA))
    plan = index.candidates(["aab"], index.store.version())._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "PushedFilters: [EqualTo(gram," in plan or "In(gram," in plan or "EqualTo(gram" in plan


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    index = GramIndex(spark, str(tmp_path))
    assert search.search(df, "abc", index=index).collect() == []
    index.upsert(df)
    index.delete(spark.createDataFrame([(1,)], "id long"))
    assert search.search(df, "abc", index=index).collect() == [] and index.store.version().numbers == {"entries": 0, "length": 0}
