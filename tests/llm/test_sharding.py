"""Histogram sort: exact contract of the rows, balance, groups, hot keys and odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import sharding

SCHEMA = "doc_id long, text string, shard string, n_chars int"


def check(rows, made, shards=24, slack=0.005):
    """The contract, plainly: every row once, right sizes, gapless slots, shares off by the tolerance and the longest text at most."""
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in made) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in made:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, longest = sum(sizes.values()), max((r["size"] for r in made), default=0)
    for k in range(shards):
        assert abs(sizes[k] - total / shards) <= 2 * (slack * total / shards + longest / 2) + 1


def run(spark, tmp_path, rows, parts=5):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sharding.op11_sharding(spark, str(tmp_path)).collect()


def texts(seed, n):
    r = random.Random(seed)
    return [(i, "é" * r.randrange(3) + "w" * int(r.expovariate(1 / 60))) for i in range(n)]


def test_contract(spark, tmp_path):
    rows = texts(1, 3000) + [(5000 + i, None) for i in range(5)] + [(6000, ""), (None, "no id"), (6001, "long " * 400)]
    check(rows, run(spark, tmp_path, rows))


@pytest.mark.parametrize("kind", ["text", "id", "row"])
def test_a_third_alike_is_split(spark, tmp_path, kind):
    """A third of the rows has one text; in the second case one id too for most; in the third all rows of the group are the same row."""
    group = {"text": lambda i: i, "id": lambda i: 7 if i % 4 else i, "row": lambda i: 7}[kind]
    rows = texts(2, 2000) + [(group(i), "alike " * 9) for i in range(1000)]
    check(rows, run(spark, tmp_path, rows))


def test_groups_within_the_tolerance_stay_whole(spark, tmp_path):
    rows = [(i, f"text {i // 7} " + "y" * 40) for i in range(3500)]
    where = []
    for parts in (2, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        schema = sharding.write_shards(df, f"{tmp_path}/{parts}", shards=5, tolerance=0.02)
        where.append({r.doc_id: r.shard for r in sharding.read_shards(spark, f"{tmp_path}/{parts}", schema).collect()})
    assert where[0] == where[1] and len(where[0]) == 3500
    assert all(where[0][i] == where[0][i - i % 7] for i in range(3500))
    assert max(Counter(where[0].values()).values()) < 1.04 * 700


def test_few_probes_and_many_parts(spark, tmp_path):
    """Several rounds, parts within shards, rows sorted by key within a shard."""
    rows = texts(3, 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    schema = sharding.write_shards(df, f"{tmp_path}/out", shards=3, part_bytes=4000, probes=16)
    made = sharding.read_shards(spark, f"{tmp_path}/out", schema)
    assert spark.read.parquet(f"{tmp_path}/out").select("part").distinct().count() > 9
    keyed = made.selectExpr("shard", "slot", "xxhash64(text) AS h", "doc_id", "octet_length(text) + 8 AS size").orderBy("shard", "slot").collect()
    assert [(r.h, r.doc_id) for r in keyed] == sorted((r.h, r.doc_id) for r in keyed)
    assert [r.slot for r in keyed] == [i for k in range(3) for i in range(sum(r.shard == k for r in keyed))]
    shares = [sum(r["size"] for r in keyed if r.shard == k) for k in range(3)]
    assert max(shares) - min(shares) < 700


def test_boundaries_against_sorted_prefix_sums(spark):
    r = random.Random(5)
    rows = [(r.choice([r.getrandbits(63), -4, 9]), r.choice([3, r.randrange(-50, 50)]), i, r.randrange(1, 90)) for i in range(800)]
    keys = spark.createDataFrame(rows, "h long, d long, t long, size long")
    total = sum(x[3] for x in rows)
    targets = [(total * k // 7, 0) for k in range(1, 7)]
    found = sharding.boundaries(keys, targets, total, probes=8)
    packed = [(int.from_bytes(sharding.pack(*(sharding.np.array([v]) for v in x[:3]))[0].ljust(24, b"\0"), "big"), x[3]) for x in rows]
    for (target, _), cut in zip(targets, found):
        best = min((abs(target - sum(s for k, s in packed if k < edge)) for edge, _ in packed), default=0)
        assert abs(target - sum(s for k, s in packed if k < cut)) == best


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
