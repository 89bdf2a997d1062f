import numpy as np
import pyarrow as pa
import pytest

from quern.llm import permutation_index as pi

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(np.float32(v).tolist())), None)
    dims = [len(v) for _, v in ok]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d))
    ok = [(i, np.float64(v)) for i, v in ok if len(v) == dim]
    out = {}
    for q, a in ok:
        if q % 20 == 0:
            best = {}
            for i, b in ok:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(a @ b))
            out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def found(spark, rows, k=20):
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)
    out = {}
    for r in pi.nearest(df, df.where("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype("f4").tolist()) for i in range(1, 90)]
    rows += [(100, [0.0] * 5), (120, None), (140, [1.0, None, 0, 0, 0]), (160, [float("nan"), 1, 1, 1, 1]), (180, [float("inf"), 0, 0, 0, 0]), (200, [1.0, 2.0]), (None, [1.0] * 5), (20, rows[19][1]), (7, rows[6][1])]
    rows += [(300 + i, [1.0, 1, 1, 1, 1]) for i in range(60)]
    got, want = found(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)
    few = [(20, [1.0, 0.0]), (21, [0.5, 0.5])]
    assert found(spark, few) == {20: [(-0.5, 21)]}
    assert found(spark, []) == {} and found(spark, [(20, None)]) == {}


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, monkeypatch, lengths):
    monkeypatch.setattr(pi, "SHARD", 1500)
    monkeypatch.setattr(pi, "BLOCK", 90)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths:
        x *= rng.uniform(0.5, 2, size=(4000, 1))
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    share = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert share >= 0.93


def test_inverted_files_by_hand():
    pivots = np.eye(4)
    files = pi.InvertedFiles.build(np.array([1, 2]), np.array([[0.9, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.9]]), pivots, 1.0, posted=2)
    posted = [[(int(r), int(p)) for r, p in zip(files.rows[a:b], files.places[a:b])] for a, b in zip(files.starts, files.starts[1:])]
    assert posted == [[(0, 0)], [(0, 1)], [(1, 1)], [(1, 0)]]


def test_the_walk_ranks_by_footrule():
    """Only the files of the walked pivots count, and the distance is that of whole loops."""
    rng = np.random.default_rng(5)
    pivots, vectors = rng.normal(size=(12, 6)), rng.normal(size=(300, 6))
    top = max((pivots**2).sum(1).max(), (vectors**2).sum(1).max())
    files = pi.InvertedFiles.build(np.arange(300), vectors, pivots, top, posted=5)
    orders = pi.pivot_orders(vectors, pivots, top, 5)
    q = rng.normal(size=6)
    walked = np.argsort(-(pivots @ q), kind="stable")[:3]
    far = []
    for i in range(300):
        place = {int(p): k for k, p in enumerate(orders[i])}
        far.append((sum(abs(at - place[int(p)]) if int(p) in place else (5 + 12) // 2 - at + at * 0 for at, p in enumerate(walked)), i))
    near = sorted(far)[:40]
    want = sorted((-float(vectors[i] @ q), i) for _, i in near)[:7]
    ids, scores = next(files.search(q[None], walked[None], np.array([-1]), 7, 5, rerank=40 / 300, depth=1))
    assert ids.tolist() == [i for _, i in want] and np.allclose(scores, [-s for s, _ in want])


def test_recall_on_the_registered_table(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(f"{folder}/embeddings.parquet"):
        pytest.skip("no tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    got = {}
    for r in pi.op2_permutation_index(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


@pytest.mark.parametrize("noise", [0.0, 0.001, 0.02, 0.05])
def test_recall_with_one_vector_or_near_copies_on_a_third_of_the_rows(spark, noise):
    rng = np.random.default_rng(3)
    n, k = 16_384, 20
    x = rng.normal(size=(n, 64))
    hot = rng.random(n) < 1 / 3
    centre = rng.normal(size=64)
    x[hot] = centre / np.linalg.norm(centre) + noise * rng.normal(size=(hot.sum(), 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {}
    for r in pi.nearest(rows, rows.where("vec_id % 128 = 0"), k).collect():
        got.setdefault(r.query_id, []).append(r.score)
    share = []
    for q in range(0, n, 128):
        scores = np.float64(x) @ np.float64(x[q])
        scores[q] = -np.inf
        least = np.sort(scores)[-k]
        share.append(sum(s >= least - 1e-12 for s in got[q]) / k)
    assert np.mean(share) >= 0.9


def test_pivots_are_distinct_and_apart():
    pool = np.array([[1.0, 0.0], [1.0, 1e-6], [2.0, 0.0], [0.0, 1.0], [-1.0, 0.1]])
    assert pi.far_apart(pool, 3).tolist() == [[1.0, 0.0], [-1.0, 0.1], [0.0, 1.0]]
    assert sorted(pi.far_apart(pool, 9).tolist()) == sorted(pool.tolist())
