import zlib

import numpy as np

from quern.llm import toxicity
from quern.llm.linear import Rows, logistic, sigmoid

BAD = ["vexhoi", "vexlum", "vextra"]


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, rng.integers(5, 120))]
        toxic = int(rng.random() < 0.15)
        for _ in range(toxic * rng.integers(1, 4)):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(BAD)) + str(rng.choice(["", "en", "a"])))
        rows.append((i, " ".join(text), toxic))
    return rows


def plain_features(text):
    text = " " + " ".join(text.lower().split()) + " "
    return {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}


def test_features_are_distinct_ngrams():
    for text in ("abc", "AbAb abab", "é  ü\n日本語 x", "a"):
        assert len(toxicity.features(text)) == len(plain_features(text))
    assert len(toxicity.features("")) == len(toxicity.features(None)) == 0
    assert (toxicity.features("AB  cd") == toxicity.features(" ab\ncd ")).all()


def test_logistic_reaches_a_flat_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = (x @ [1, -2, 0.5, 0] + rng.normal(size=200) > 0).astype(float)
    w, b = logistic(Rows([np.arange(4)] * len(x), 4, list(x)), y, l2=0.5, steps=200)
    g = sigmoid(x @ w + b) - y
    assert np.abs(x.T @ g + 0.5 * w).max() < 0.05 and abs(g.sum()) < 0.05


def test_held_out_accuracy(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    out = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 300
    assert np.mean([(s >= 0.3) == y for s, y in out]) > 0.98
    alone = toxicity.fit([t for _, t, _ in rows[:400]], [y for *_, y in rows[:400]])
    text = "word " * 3000 + "vexlum"
    assert alone.scores([text])[0] > alone.scores(["word " * 3000])[0] + 0.3


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "vexlum", None), (4, "x" * 100000, "c")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)  # one class only
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.toxicity <= 1 for r in got)
    none = toxicity.train(docs, labels.where("false"))
    assert all(r.toxicity < 0.01 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.where("false"), model).collect() == []
