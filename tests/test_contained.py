"""The containment join and filter against all pairs and the loop."""

import random

from quern.operators import contained


def texts(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde ") for _ in range(r.choice([3, 9, 40, 150, 400]))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = r.choice(base)
        k = r.random()
        if k < 0.4:
            a = r.randrange(len(t))
            t = t[a : a + r.randrange(1, 200)]
        elif k < 0.6:
            t = t + r.choice(base)
        out.append(t)
    return out


def test_pairs_equal_all_pairs(spark):
    found = sorted(set(texts(1, 260)) | {"a", "é😀", "x" * 500, "y" + "x" * 600})
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(found)], "key string, text string").repartition(3)
    got = {(int(r.small), int(r.large)) for r in contained.contained_pairs(df).collect()}
    assert got == {(i, j) for i, a in enumerate(found) for j, b in enumerate(found) if i != j and a in b} and len(got) > 100


def test_filter_equals_the_loop(spark):
    rows = [*texts(2, 200), "", None, "é", "a"]
    known = [*texts(3, 8), "", None]
    held, stays = [k for k in known if k], []
    for i, t in enumerate(rows):
        if t and not any(t in x or x in t for x in held):
            held.append(t)
            stays.append(i)
    new = spark.createDataFrame(list(enumerate(rows)), "position long, text string").selectExpr("*", "'x' AS key")
    old = spark.createDataFrame([(k,) for k in known], "text string")
    got = contained.not_contained(new, old, "text")
    assert sorted(r.position for r in got.collect()) == stays and len(stays) > 5 and got.columns == new.columns


def test_empty(spark):
    none = spark.createDataFrame([], "position long, text string")
    assert contained.not_contained(none, none, "text").collect() == []


def test_nothing_large_is_broadcast(spark, tmp_path):
    """Spark takes the marks of a file's texts for a fraction of their size; a broadcast of them ends the driver."""
    spark.createDataFrame([(str(i), t) for i, t in enumerate(sorted(set(texts(4, 100))))], "key string, text string").write.parquet(f"{tmp_path}/texts")
    df = contained.checkpointed(spark.read.parquet(f"{tmp_path}/texts"))
    plan = contained.contained_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan


def test_marks_of_long_texts_are_rare():
    """Texts of the same few words share short grams, but hardly one of the grams that long texts are looked for by."""
    r = random.Random(6)
    seen = [set(contained.marks("".join(r.choice(("the", "ing", "an", "er", "tion", " ")) for _ in range(200)), [64])[64].tolist()) for _ in range(300)]
    assert max(sum(m in x for x in seen) for m in seen[0]) <= 2
