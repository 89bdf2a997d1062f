import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quern.llm import mixing


def nearest_sum(sizes, counts, budget):
    sums = {0}
    for size, n in zip(sizes.tolist(), counts.tolist()):
        sums = {a + k * size for a in sums for k in range(n + 1)}
    return min(abs(a - budget) for a in sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 400))
def test_fit_is_the_best_sum(groups, budget):
    sizes, counts = np.array(list(groups)), np.array(list(groups.values()))
    taken = mixing.fit(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    # The share that is settled beforehand may cost something, a wide window nothing.
    assert abs(int((taken * sizes).sum()) - budget) <= nearest_sum(sizes, counts, budget) + max(sizes) / 2
    free = mixing.fit(sizes, counts, budget, window=10**6)
    assert abs(int((free * sizes).sum()) - budget) == nearest_sum(sizes, counts, budget)


@pytest.mark.parametrize("sizes,counts,budget,off", [([400], [1], 399, 1), ([400, 300], [1, 1], 650, 50), ([100], [5], 260, 40), ([400], [1], 100, 100), ([7], [3], 22, 1)])
def test_a_sum_above_may_be_the_nearest(sizes, counts, budget, off):
    taken = mixing.fit(np.array(sizes), np.array(counts), budget)
    assert abs(int((taken * np.array(sizes)).sum()) - budget) == off


def test_the_dynamic_program_hits_reachable_sums():
    sizes = np.array([7, 11, 13, 40])
    counts = np.array([3, 2, 2, 1])
    for budget in range(1, int((sizes * counts).sum())):
        got = int((mixing.fit(sizes, counts, budget, window=100) * sizes).sum())
        assert abs(got - budget) == nearest_sum(sizes, counts, budget)


def test_a_source_with_one_large_document_is_taken(spark):
    rows = [(1, "w " * 400, "a")] + [(10 + i, "w " * 20, "b") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cap=5).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert one.taken == 400 * round(one.target / 400)


def plain_targets(sizes):
    total, done = sum(sizes), {}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    while True:
        rest = total - sum(done.values())
        todo = [i for i in range(len(sizes)) if i not in done]
        if not todo:
            return [done[i] for i in range(len(sizes))]
        w = sum(weights[i] for i in todo)
        over = [i for i in todo if rest * weights[i] / w > 3 * sizes[i]]
        if not over:
            return [done.get(i, rest * weights[i] / w) for i in range(len(sizes))]
        done.update((i, 3 * sizes[i]) for i in over)


def budgets(rows, got):
    """Sizes and the words taken of each source, against targets worked out by loops."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    names = sorted([s for s in per if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in per if s is None]
    goal = dict(zip(names, plain_targets([per[s] for s in names])))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, size(t)) for d, t, _ in rows)
    source = {d: s for d, _, s in rows}
    taken, sizes = defaultdict(int), defaultdict(list)
    for r in got:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[s] += r.taken
        sizes[s].append(r.size)
    for s in names:
        reach = 1  # all sums of documents taken up to three times, as bits
        for z in sizes[s]:
            reach |= reach << z
            reach |= reach << 2 * z
        want = round(goal[s])
        below = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
        above = reach >> want
        near = min(want - below, (above & -above).bit_length() - 1 if above else want)
        assert abs(taken[s] - goal[s]) <= near + goal[s] / 1000 + 1
    return per, goal, source


def check(rows, got):
    per, goal, source = budgets(rows, got)
    for r in got:
        assert r.source_size == per[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 5)
    monkeypatch.setattr(mixing, "HOT", 8)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "é", "", None, "z\U0001f600"][min(5, int(rng.exponential(1.5)))]) for i in range(600)]
    rows += [(1000 + i, "one two three", "a") for i in range(300)] + [(2000, None, "a"), (2001, "x\x0by\x1cz\xa0q", "tiny"), (2002, "v " * 50000, "b")]
    docs = spark.createDataFrame([(d, t, s, 0.0) for d, t, s in rows], "doc_id long, text string, source string, target double")
    got = mixing.mix(docs).collect()
    check(rows, got)
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    kept = mixing.mixed_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.taken // r.size for r in got if r.size)


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    twice = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], schema)).collect()
    assert [tuple(r) for r in twice] == [(1, 2, 4, 4.0, 2)] * 2
