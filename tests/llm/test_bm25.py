import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import bm25


def brute(rows, asked, k=10):
    docs = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in rows if i is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs)) or 1.0
    df = Counter(w for _, c in docs for w in c)
    out = defaultdict(list)
    for q, t in dict.fromkeys((q, t) for q, t in asked if q is not None and t is not None):
        best = {}
        for i, c in docs:
            s = 0.0
            for w in set(re.findall(r"\w+", t.lower())):
                if w in c:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if s > 0:
                best[i] = max(best.get(i, 0.0), round(s, 9))
        out[q] += sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: sorted(v) for q, v in out.items() if v}


def found(spark, rows, asked, **kw):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    out = defaultdict(list)
    for r in bm25.search(docs, queries, **kw).orderBy("query_id", "rank").collect():
        out[r.query_id].append((-r.score, r.doc_id))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard,queries,width", [(8192, 8192, 8), (40, 7, 8), (16, 8192, 1), (64, 8192, 100), (300, 20, 3)])
def test_against_all_documents(spark, monkeypatch, shard, queries, width):
    for name, value in (("SHARD", shard), ("BLOCK_QUERIES", queries), ("TASK_DOCS", 60), ("WIDTH", width)):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(7, "w1 w399"), (None, "w1"), (2000, None), (2001, ""), (2002, "Ünï_9 W1! w1-w2 " * 500)]
    asked = [r for r in rows if r[0] is not None and r[0] % 25 == 0] + [(3, "W1 w1, w2?"), (4, ""), (5, None), (6, "nothing"), (8, "ünï_9"), (8, "ünï_9"), (9, rows[5][1])]
    got, want = found(spark, rows, asked), brute(rows, asked)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=2e-9)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == {}
    assert found(spark, [(1, "a")], []) == {}
    assert found(spark, [(1, "a")], [(1, "a")], k=3).keys() == {1}


def test_postings_of_resting_lists_are_skipped():
    """Frequent words rest once the threshold is above what they can add up to."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[i // 500]}{w}" for w in rng.integers(0, 300, 40)) + " the of and to in" * int(rng.integers(1, 4)) for i in range(1000)]
    block = bm25.Block(np.arange(20), ["\0".join(sorted(set(bm25.terms(t)))) for t in texts[:20]])
    number = {w: i for i, w in enumerate(block.words)}
    counted = [Counter(w for w in bm25.terms(t) if w in number) for t in texts]
    df = np.zeros(len(block.words), dtype=np.int64)
    for c in counted:
        df[[number[w] for w in c]] += 1
    lengths = np.array([len(bm25.terms(t)) for t in texts])
    block.weigh(df, 1000, int(lengths.sum()))
    rows = [(number[w], i, n) for i, c in enumerate(counted) for w, n in c.items()]
    shard = bm25.Shard(block, np.arange(1000), lengths, *(np.array(x) for x in zip(*rows)))
    for q in range(20):
        scores, docs = shard.search(q, 10, np.zeros(0), np.zeros(0, np.int64))
        assert docs[0] == q and len(docs) == 10
        shard.search(q, 10, scores, docs)
    assert shard.walked < 0.6 * shard.posted


@pytest.mark.parametrize("sparse,dense,together,few,width", [(1000, 1024, 256, 8, 8), (1000, 3, 5, 2, 1), (2, 1024, 7, 3, 8), (16, 1024, 256, 8, 100)])
def test_many_queries_at_once_equal_all_scores(monkeypatch, sparse, dense, together, few, width):
    """Scores that differ by less than single precision, counts beyond 16 bits and repeated ids; shards searched one after the other."""
    for name, value in (("SPARSE", sparse), ("DENSE", dense), ("TOGETHER", together), ("FEW", few), ("WIDTH", width)):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(7)
    n, words, asked = 600, 60, 40
    there = rng.random((words, n)) < np.linspace(0.02, 0.9, words)[:, None]
    there[:, 100:160] = there[:, 100:101]
    there[:, 40] = there[:, 41] = False
    counts = np.where(there, rng.integers(1, 4, (words, n)), 0)
    counts[:, 100:160] = counts[:, 100:101]
    counts[-1, 300] = 70_000
    lengths = 10**8 + 2 * rng.permutation(n)  # neighbours differ by 2e-8 of their length
    ids = np.arange(n) // 2 * 7 if few == 3 else rng.permutation(n)
    block = bm25.Block(np.arange(asked), ["\0".join(f"w{w:02d}" for w in rng.choice(words, rng.integers(0, 40), replace=False)) for _ in range(asked)])
    mine = np.array([int(w[1:]) for w in block.words])
    block.weigh((counts[mine] > 0).sum(axis=1), n, int(lengths.sum()))
    best = bm25.Best(asked, 10)
    for part in (slice(0, 350), slice(350, 600)):
        term, doc = np.nonzero(counts[mine][:, part])
        shard = bm25.Shard(block, ids[part], lengths[part], term, doc, counts[mine][:, part][term, doc])
        shard.search_all(block.order, best)
    norm = 1.2 * (0.25 + 0.75 * lengths / block.mean)
    weight = block.idf[:, None] * counts[mine] * 2.2 / (counts[mine] + norm)
    for q in range(asked):
        total, most = np.round(weight[block.cols[block.at[q] : block.at[q + 1]]].sum(axis=0), 9), {}
        for i, s in zip(ids.tolist(), total.tolist()):
            if s > 0:
                most[i] = max(s, most.get(i, 0.0))
        scores, docs = best.of(q)
        want = sorted((-s, i) for i, s in most.items())[:10]
        assert np.allclose(scores, [-s for s, _ in want], atol=2e-9, rtol=0)
        assert all(abs(most[i] - s) <= 2e-9 for i, s in zip(docs.tolist(), scores.tolist())) and len(set(docs.tolist())) == len(want)
