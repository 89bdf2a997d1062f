"""Scans of keys larger than a chunk against plain loops."""

import random

import pytest

from quern.operators import chunked, sequences as Q


def rows_of(seed, keys=4, most=300, span=400):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(keys)]) if i % 3 else 0, r.randrange(span), i) for i in range(most)]
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("chunk,gap", [(20, 1), (20, 7), (15, 90), (1000, 30)])
def test_alerts_equal_the_loop(spark, chunk, gap):
    for seed, span in ((1, 400), (2, 5000)):
        rows = rows_of(seed, span=span)
        expected = {}
        for k, own in by_key(rows).items():
            last, expected[k] = None, []
            for _, t, _ in own:
                if last is None or t - last >= gap:
                    expected[k].append(t)
                    last = t
        found = {}
        for r in Q.emitted_alerts(spark.createDataFrame(rows, "k int, t long, id long"), "k", "t", gap, chunk).collect():
            found.setdefault(r.k, []).append(r.t)
        assert {k: sorted(v) for k, v in found.items()} == expected


@pytest.mark.parametrize("chunk,most,span", [(20, 3, 15), (25, 1, 60), (1000, 5, 40), (30, 4, 10_000)])
def test_rate_limit_equals_the_loop(spark, chunk, most, span):
    rows = [(k, 10 * t + n % 7, i) for i, (k, t, n) in enumerate(rows_of(3, span=900))]
    rows = list({(k, t): (k, t, i) for k, t, i in rows}.values())  # without ties, whose order the loop doesn't know
    expected = {}
    for own in by_key(rows).values():
        held = []
        for _, t, i in own:
            held = [h for h in held if h > t - span]
            expected[i] = len(held) < most
            if expected[i]:
                held.append(t)
    df = spark.createDataFrame(rows, "k int, t long, id long")
    assert {r.id: r.allowed for r in Q.rate_limited(df, "k", "t", most, span, chunk).collect()} == expected


def test_todo_batches_equal_the_loop(spark):
    r = random.Random(4)
    for share in (0.02, 0.3):
        rows, t = [], {}
        for i in range(260):
            k = r.choice([0, 0, 0, 1, 2, None])
            t[k] = t.get(k, 0) + r.randrange(4)
            rows.append((k, i, "pending" if r.random() < share else "completed", t[k], t[k] + r.randrange(5)))
        expected = set()
        for own in by_key([(k, c, i, s, u) for k, i, s, c, u in rows]).values():
            own.sort(key=lambda x: (x[1], x[2]))
            first, done, last = 0, True, None
            for n, (_, created, _, status, updated) in enumerate(own):
                if n and done and created >= last:
                    first, done, last = n, True, None
                done = done and status == "completed"
                last = updated if last is None else max(last, updated)
            expected |= {x[2] for x in own[first:]}
        df = spark.createDataFrame(rows, "session_id int, id long, status string, created_at long, updated_at long")
        for chunk in (30, 1000):
            assert {x.id for x in Q.todo_batches(df, rows=chunk).collect()} == expected


def test_a_machine_that_forgets_takes_two_rounds(spark):
    calls = spark.sparkContext.accumulator(0)

    def run(frame, state, last):
        calls.add(1)
        return frame[["k", "t"]], "gone" if frame["t"].max() % 2 >= 0 else state

    df = chunked.in_chunks(spark.createDataFrame([("a", i) for i in range(100)], "k string, t long"), "k", ["t"], 10)
    assert chunked.scan(df, ["t"], run, "k string, t long").count() == 100
    chunks = df.select(chunked.CHUNK).distinct().count()
    assert chunks >= 8 and calls.value <= 3 * chunks


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t long")
    assert Q.emitted_alerts(df, "k", "t", 5).count() == 0 and Q.rate_limited(df, "k", "t", 2, 5).count() == 0
