import numpy as np
import pytest

from quern.llm import quality


def corpus(n, seed=2):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, rng.integers(20, 150))]
        bad = int(rng.random() < 0.25)
        if bad:
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else [w for w in text[:6] for _ in range(12)]
        rows.append((i, " ".join(text), "junk" if bad and rng.random() < 0.7 else f"s{i % 3}", 1 - bad))
    return rows


def test_views():
    cols, vals = quality.content("aaaa bbbb")
    grams = [" aaaa bbbb "[i : i + 3] for i in range(9)]
    assert len(cols) == len(set(grams)) + 3 and (vals[:-3] ** 2).sum() == pytest.approx(1)
    _, vals = quality.metadata("AB c\n1!", ("en", None))
    assert vals[2:6].tolist() == pytest.approx([2 / 7, 1 / 7, 1 / 7, 2 / 7])
    assert quality.metadata("x", ("en", "a"))[0][:2].tolist() != quality.metadata("x", ("en", None))[0][:2].tolist()


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 5 == 0], "doc_id long, quality int")
    model = quality.train(docs, labels, handed=40)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    out = [(got[i], y) for i, _, _, y in rows if i % 5]
    assert np.mean([(s >= 0.5) == y for s, y in out]) > 0.97
    again = quality.train(docs.repartition(5), labels, handed=40)
    assert np.allclose(again.mix, model.mix, atol=1e-6)


def plain_co_training(rows, labels, handed, rounds):
    """The same by loops: everything scored in each round, the surest handed over."""
    from pyspark.sql import functions as F  # noqa: F401

    texts, keys, ids = [r[1] for r in rows], [("en", r[2]) for r in rows], [r[0] for r in rows]
    hashes = rows[0][4]
    known = [i for i in range(len(rows)) if ids[i] in labels]
    lent = []
    good = np.mean([labels[ids[i]] for i in known])

    def fitted():
        at = sorted(known, key=lambda i: ids[i]) + [i for v in (0, 1) for i in sorted((i for i, _, w in lent if w == v), key=lambda i: ids[i])]
        y = [labels[ids[i]] for i in sorted(known, key=lambda i: ids[i])] + [y for v in (0, 1) for _, y, w in sorted((x for x in lent if x[2] == v), key=lambda x: ids[x[0]])]
        taught = [-1] * len(known) + [v for v in (0, 1) for *_, w in lent if w == v]
        return quality.fit([texts[i] for i in at], [keys[i] for i in at], np.array(y, dtype=float), np.array(taught))

    model = fitted()
    for _ in range(rounds):
        z = model.both(texts, keys)
        new = []
        for v in (0, 1):
            taken = {i for i, _, w in lent if w == 1 - v}
            free = [i for i in range(len(rows)) if ids[i] not in labels and i not in taken]
            best = sorted((i for i in free if z[i, v] >= np.log(19)), key=lambda i: (-z[i, v], hashes[ids[i]], ids[i]))
            worst = sorted((i for i in free if z[i, v] <= np.log(0.25)), key=lambda i: (z[i, v], hashes[ids[i]], ids[i]))
            new += [(i, 1.0, 1 - v) for i in best[: max(1, round(handed * good))]] + [(i, 0.0, 1 - v) for i in worst[: max(1, round(handed * (1 - good)))]]
        lent += new
        model = fitted()
    return model


def test_against_plain_co_training(spark):
    from pyspark.sql import functions as F

    rows = corpus(500, seed=5)
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string")
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    labels = {i: float(y) for i, _, _, y in rows if i % 4 == 0}
    model = quality.train(docs, spark.createDataFrame([(i, int(y)) for i, y in labels.items()], "doc_id long, quality int"), handed=30, rounds=2)
    plain = plain_co_training([(*r, hashes) for r in rows], labels, 30, 2)
    got = model.scores([r[1] for r in rows], [("en", r[2]) for r in rows])
    want = plain.scores([r[1] for r in rows], [("en", r[2]) for r in rows])
    assert np.allclose(got, want, atol=1e-6)


def test_few_labels_gain_from_the_other_view(spark):
    rows = corpus(900, seed=4)
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows[:60]], "doc_id long, quality int")
    texts, keys = [r[1] for r in rows[60:]], [("en", r[2]) for r in rows[60:]]
    y = np.array([r[3] for r in rows])[60:]
    right = lambda m: ((m.scores(texts, keys) >= 0.5) == y).mean()
    together, alone = quality.train(docs, labels, handed=80), quality.train(docs, labels, rounds=0)
    assert right(together) >= right(alone) - 0.02 and right(together) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "b"), (2, "", "b"), (None, "x", None), (4, "x" * 100000, "c")], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(r.quality_score == pytest.approx(0.5) for r in got)
    assert quality.score(docs.where("false"), quality.train(docs.where("false"), labels)).collect() == []
    mixed = quality.fit(["a b c", None, ""] * 10, [("x", None)] * 30, np.array([1.0, 0.0, 1.0] * 10), np.array([-1, -1, 0] * 10))
    assert mixed.scores(["a b c", None], [("x", None)] * 2).tolist() == sorted(mixed.scores(["a b c", None], [("x", None)] * 2).tolist(), reverse=True)
