"""Near-duplicate titles against the greedy scan: across hosts, with deferral and limits, and the similarity join alone."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import search


def pairs(t):
    t = "".join(c for c in t.lower() if c.isalnum())
    return frozenset(t[i : i + 2] for i in range(len(t) - 1))


def like(a, b, share=0.82):
    return bool(a and b) and len(a & b) / len(a | b) >= share


def greedy(rows, most=None, tokens=None, share=0.82):
    """(kept, deferred) in order, plainly: rows of (id, url, title, snippet)."""
    seen, kept, deferred = set(), [], []
    for i, u, t, snippet in rows:
        if u in seen or any(like(pairs(t), p, share) for _, p in kept):
            continue
        seen.add(u)
        if tokens and not any(x in f"{t} {snippet}".lower() for x in tokens):
            deferred.append(i)
            continue
        kept.append((i, pairs(t)))
        if most and len(kept) >= most:
            return [i for i, _ in kept]
    out = [i for i, _ in kept]
    return out + (deferred[: most - len(out)] if most else deferred)


def made(seed, n, urls=80):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(50)]
    titles = [" ".join(r.choice(words) for _ in range(r.randint(1, 8))) for _ in range(n // 6)]

    def changed(t):
        k = r.random()
        if k < 0.4:
            return t
        at = r.randrange(len(t) + 1)
        return t[:at] + r.choice("xyz ") + t[at:] if k < 0.8 else t[: r.randint(len(t) // 2, len(t))]

    return [(i, f"h{r.randrange(urls)}.com/x", changed(r.choice(titles)), r.choice(["", "some snippet", "of words"])) for i in range(n)]


SCHEMA = "id long, url string, title string, snippet string"


@pytest.mark.parametrize("share", [0.82, 0.5, 0.9])
def test_join_finds_every_pair(spark, share):
    sets = {pairs(t) for _, _, t, _ in made(1, 400)} - {frozenset()}
    named = {f"s{i}": p for i, p in enumerate(sorted(map(sorted, sets)))}
    df = spark.createDataFrame([("", s, p) for s, p in named.items()], "g string, s string, pairs array<string>")
    found = {(r.a, r.b) for r in search.similar_sets(df, share).collect()}
    assert found == {(a, b) for a, p in named.items() for b, q in named.items() if a != b and like(set(p), set(q), share)} and found


@pytest.mark.parametrize("alike,dear", [(1, 0.0), (2, 0.0), (3, 0.0)])
def test_more_equal_parts_lose_no_pair(spark, monkeypatch, alike, dear):
    monkeypatch.setattr(search, "MOST_ALIKE", alike)
    monkeypatch.setattr(search, "DEAR", dear)
    test_join_finds_every_pair(spark, 0.82)


def test_greedy_order(spark):
    rows = made(2, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    found = search.near_duplicates(df, None, F.col("url"), "title", "id")
    assert sorted(r.id for r in found.collect()) == sorted(greedy(rows)) and found.columns == df.columns


@pytest.mark.parametrize("most", [None, 5, 40, 1000])
def test_deferral_and_limit(spark, most):
    rows = made(3, 250, urls=150)
    word = rows[0][2].split()[0] + " snippet ab"
    tokens = search.query_tokens(word)
    df = spark.createDataFrame(rows, SCHEMA)
    found = search.near_duplicates(df, None, F.col("url"), "title", "id", on_topic=search.shares_token(word, F.col("title"), F.col("snippet")), limit=most).collect()
    expected = greedy(rows, most, tokens)
    assert sorted(r.id for r in found) == sorted(expected)
    assert 0 < sum(r.deferred for r in found) < len(found) or most in (5, 40)


def test_groups_are_apart(spark):
    rows = made(4, 200)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.col("id") % 3)
    found = search.near_duplicates(df, "host", F.col("url"), "title", "id", on_topic=F.lit(True), limit=7)
    assert sorted(r.id for r in found.collect()) == sorted(i for h in range(3) for i in greedy([r for r in rows if r[0] % 3 == h], 7))


def test_tokens_and_urls(spark):
    assert search.query_tokens("How to 优化排序 C++ a_bc x1y") == ["how", "优化排序", "优化", "化排", "排序", "x1y"]
    df = spark.createDataFrame([("https://www.A.com/x//",), ("http://a.com/x/?q#f",), ("no url/",), ("http://a.com/",)], "u string")
    assert [r.n for r in df.select(S.normal_url(F.col("u")).alias("n")).collect()] == ["a.com/x/", "a.com/x", "no url/", "a.com"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert search.near_duplicates(df, None, F.col("url"), "title", "id", limit=3).collect() == []
