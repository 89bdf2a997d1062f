import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import components


def plain(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    return sorted((tuple(r) for r in simhash.near_duplicates(docs, **kw).collect()), key=str)


@pytest.mark.parametrize("text", ["", None, "a", "A b C", "a b c d", "a b c d e", "É\x0b\tÀ x\x1cy  z \n w \xa0 v", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def test_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    rows = [(5, None), (3, ""), (9, "  \n"), (7, "same text here now again"), (2, "Same TEXT here now again"), (2, "Same TEXT here now again"), (None, "alone with no id at all here"), (None, " ".join(base)), (11, " ".join(base))]
    rows += [(100 + k, " ".join(base * 12 + [f"w{k}"])) for k in range(12)] + [(50, "long " * 30000 + "end")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_random_fingerprints_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            p = c
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                p ^= 1 << int(b)
            points.add(p)
    points = sorted(points)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    arr = np.array(points, dtype=np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    label = np.arange(len(arr))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(arr))])
        if (new == label).all():
            break
        label = new
    for block, small in ((8192, 16), (3, 2)):  # the second: many cells are worked through in blocks
        edges = simhash.links(frame, most=block, small=small)
        found = {r.node & (1 << 64) - 1: r.component for r in components(edges).collect()}
        groups = Counter()
        mine = {}
        for p, l in zip(points, label.tolist()):
            groups[l] += 1
        for p, l in zip(points, label.tolist()):
            if groups[l] == 1:
                assert p not in found
            else:
                assert mine.setdefault(l, found[p]) == found[p]
        assert len(set(mine.values())) == len(mine)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_one_of_each(spark):
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "something else entirely is here now")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _kept string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [2, 9]


def test_more_fingerprints_want_more_groups():
    chosen = [simhash.groups_for(n) for n in (10, 10**6, 10**8, 10**10, 10**12)]
    assert chosen[:2] == [7, 7] and chosen == sorted(chosen) and chosen[-1] > 8


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, "a b c d e", s) for s in ("x", "y", None)] * 3 + [(2, "a b c d e", "z"), (3, "other words here they are", "w"), (None, "a b c d e", "n")]
    made = [sorted(map(tuple, simhash.one_of_each(spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(n)).collect())) for step, n in ((1, 1), (-1, 3))]
    assert made[0] == made[1] and [r[0] for r in made[0]] == [1, 3]
