"""Collocations against a plain recount, the perfect hash, slices of tables, odd inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import collocations as C

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_count, top=2000, covered=80, longest=4):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in often.items():
            if 100 * inside[p] >= covered * a:
                continue
            cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, count, words=30, lang=("en", "fr", None, "und")):
    r = random.Random(seed)
    vocabulary = [r.choice(["a", "B", "É", "ß", "x"]) + str(i) for i in range(words)]
    for _ in range(count):
        made = []
        for _ in range(r.randrange(40)):
            made += r.choice([[r.choice(vocabulary)], vocabulary[3:6], vocabulary[7:11], ["The", "end"]])
            made.append(r.choice([" ", " ", "\t ", ", ", ".", " !\n", "\x0b"]))
        yield r.choice(lang), " ".join(made)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS slot").repartition(4)
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def test_perfect_hash_is_minimal_and_checked():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 62, n))
        t = C.KeyTable(keys)
        assert sorted(t.find(keys).tolist()) == list(range(len(keys))) if n else len(t) == 0
        if n:
            assert (t.find(np.setdiff1d(r.integers(0, 1 << 62, 5000), keys)) == -1).all()
    words = [f"w{i}".encode() for i in range(3000)]
    t = C.WordTable(words)
    assert [t[s] for s in t.find(words)] == words
    assert (t.find([b"no", b"w3001"]) == -1).all()


def test_against_plain_recount(spark):
    rows = list(corpus(1, 250))
    made = run(spark, rows, min_count=5)
    assert made == plain(rows, 5) and len(made) > 50


def test_thresholds_and_tops(spark):
    rows = list(corpus(2, 120, words=8)) * 3
    assert run(spark, rows, min_count=130, top=7) == plain(rows, 130, top=7)
    assert run(spark, rows, min_count=6, covered=50, longest=3, top=15) == plain(rows, 6, 15, 50, 3)


def test_slices_do_not_matter(spark, monkeypatch):
    rows = list(corpus(3, 120))
    monkeypatch.setattr(C, "TABLE_KEYS", 20)
    assert run(spark, rows, min_count=4) == plain(rows, 4)


def test_odd_texts(spark):
    rows = [("en", None), ("en", ""), (None, " .,;\t"), (None, "a b c d " * 40), ("en", "é\x85f\x00g É\x1ch " * 40), ("und", "a b " * 30), ("de", "x")]
    made = run(spark, rows)
    assert made == plain(rows, 30) and {r[0] for r in made} == {"und", "en"}


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("name", ["op12_collocations"])
def test_query(spark, name, tmp_path):
    rows = list(corpus(4, 150, words=12))
    spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = C.QUERIES[name](spark, str(tmp_path))
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in made.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(tuple(r) for r in made.collect()) == plain(rows, 30)
