import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import Row

import corpus_pipeline
from quern.llm import quality, simhash, toxicity
from quern.llm.training_order import encoder
from test_mixing import budgets as check_budgets
from test_simhash import brute as components


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = [str(w) for w in rng.choice(words, rng.integers(15, 90))]
        toxic, bad = int(rng.random() < 0.12), int(rng.random() < 0.15)
        if toxic:
            text.insert(3, "vexhoien")
        if bad:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en", ["a", "b", "c", None][min(3, i % 7)], 0))
        labels.append((i, 1 - bad, toxic))
    rows += [(600 + k, rows[k % 3][1] + " ", "en", "a", 0) for k in range(30)] + [(700, None, None, None, None), (701, "", "en", "a", 0)]
    folder = tmp_path_factory.mktemp("tables")
    cols = list(zip(*rows))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array(cols[4], pa.int64())}), f"{folder}/documents.parquet")
    cols = list(zip(*labels))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "quality": pa.array(cols[1], pa.int32()), "toxic": pa.array(cols[2], pa.int32())}), f"{folder}/labels.parquet")
    return str(folder), rows, labels


def test_stages_against_brute_force(spark, tables):
    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    texts = {r[0]: r for r in rows}

    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == names
    like = lambda marked: marked | {600 + k for k in range(30) if k % 3 in marked}  # noqa: E731  copies are alike
    toxic = like({i for i, _, t in labels if t})
    ids = {r.doc_id for r in kept.collect()}
    assert len(toxic & ids) <= 1 and len(ids - toxic) >= len(rows) - len(toxic) - 2

    good = corpus_pipeline.keep_good(spark, kept, folder)
    assert good.columns == names
    bad = like({i for i, q, _ in labels if not q})
    after = {r.doc_id for r in good.collect()}
    assert len(bad & after) <= 1 and len(ids - after - bad) <= 3

    single = corpus_pipeline.drop_near_duplicates(spark, good, folder)
    assert single.columns == names
    want = {c for _, _, c in components([(i, texts[i][1]) for i in after])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want)

    mixed = corpus_pipeline.mix_sources(spark, single, folder)
    assert mixed.columns == names
    found = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    words = {d: len((texts[d][1] or "").split()) for d in want}
    table = [Row(doc_id=d, size=words[d], taken=found.get(d, 0) * words[d]) for d in want]
    check_budgets([(d, texts[d][1], texts[d][3]) for d in want], table)

    tokenizer = encoder()
    ids = {r.doc_id: r for r in corpus_pipeline.encode(spark, mixed, folder).collect()}
    for d, r in ids.items():
        packed = np.array(tokenizer.encode(texts[d][1], disallowed_special=()), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[d][1].encode()).hexdigest())


def test_run(spark, tables):
    folder, *_ = tables
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    assert quality.THRESHOLD == 0.5 and toxicity.THRESHOLD == 0.3 and simhash.SEED == 42
