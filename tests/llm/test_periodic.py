"""Runs against a quadratic search, the whole query against a plain version, odd inputs."""

import random
import zlib
from hashlib import sha256

import pytest

from quern.llm import periodic


def plain(x):
    """(start, length, period) of all runs: each period's maximal stretches of equal words, smallest period first."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().split() if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id,
        len(runs),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        x = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            p = r.randrange(1, 9)
            x += (x[-p:] or ["a"]) * r.randrange(1, 6) + [r.choice("abé") for _ in range(r.randrange(3))]
        yield x


def test_runs_equal_quadratic_search():
    for x in texts(1, 2000):
        assert periodic.runs_of(x) == plain(x), x


def test_mask_keeps_every_run():
    group = list(texts(2, 500))
    found = list(periodic.search([" ".join(x).encode() for x in group]))
    assert [f for f, _, _ in found] == [plain(x) for x in group]
    unlike = [str(i).encode() for i in range(5000)]
    assert next(periodic.search([b" ".join(unlike)]))[0] == []


def test_chunks_do_not_matter(monkeypatch):
    group = [" ".join(x).encode() for x in texts(3, 200)]
    whole = list(periodic.search(group))
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 50)
    assert list(periodic.search(group)) == whole


def test_long_periodic_text():
    x = [i % 700 for i in range(30_000)]
    assert periodic.runs_of(x) == [(0, 30_000, 700)]
    assert periodic.runs_of([1] * 5000) == [(0, 5000, 1)]


def test_query_against_plain_version(spark, tmp_path):
    made = [(i, " ".join(x)) for i, x in enumerate(texts(4, 400))]
    made += [(7, None), (None, "a a a a a a b"), (8, ""), (9, " \t\n "), (10, "a\x0bb\x0cc\rd\x1ce\x85f　g " * 9), (11, "x y " * 3000), (11, "x y " * 3000)]
    made += [(i, f"w{i} and the rest of a sentence that goes on {i}") for i in range(1000, 1100)]
    df = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'x' AS runs", "1 AS __found", "'en' AS lang")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in made) > 20
    assert rows_of(periodic.op13_periodic(spark, str(tmp_path))) == sorted((plain_row(*m) for m in made), key=str)


def test_general_interface_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "q w q w q w q w", "k"), (2, None, "l")], "id int, body string, __found string").selectExpr("*", "0 AS best")
    out = periodic.periodic_runs(df, "body").orderBy("id").collect()
    assert out[0]["__found"] == "k" and out[0]["collapsed"] == "q w" and out[0]["best"].period == 2 and out[0]["words"] == 8
    assert out[1]["runs"] == [] and out[1]["best"] is None and out[1]["collapsed"] == ""


@pytest.mark.parametrize("count", [0])
def test_empty_table(spark, tmp_path, count):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert periodic.op13_periodic(spark, str(tmp_path)).count() == count
