import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from quern.llm import bpe, training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = to.slots(np.arange(n), n)
    assert sorted(got.tolist()) == list(range(n))
    assert (to.slots(np.arange(n)[::-1], n) == got[::-1]).all()
    if n >= 1000:
        assert (to.slots(np.arange(n), n, key=5) != got).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1


def stream(texts, length):
    """The sequences of all texts, one after the other."""
    ids = [i for t in texts for i in [*np.frombuffer(bpe.codec(None).encode([t])[0], dtype="<u4").tolist(), 50256]]
    ids += [50256] * (-len(ids) % length)
    return [ids[k : k + length] for k in range(0, len(ids), length)]


def shard_files(folder):
    return {int(p.parent.name.split("=")[1]): p.read_bytes() for p in folder.glob("shard=*/*.txt")}


ROWS = [(i, f"text number {i} " * (i % 9 + 1), "x") for i in range(150)] + [(7, "again", "x"), (7, "again", "x"), (None, "no id", "x"), (900, None, "x"), (901, "", "x"), (902, "long text " * 3000, "x"), (903, "x" * 200_000, "x")]
SCHEMA = "doc_id long, text string, slot string"


def sequences(files, length, per):
    """All sequences by slot."""
    out = {}
    for shard, data in files.items():
        assert len(data) % to.stride(length) == 0 and len(data) // to.stride(length) <= per
        for k, ids in enumerate(to.read(data, 0, length)):
            slot = shard * per + k
            assert to.place(slot, length, per) == (shard, k * to.stride(length))
            out[slot] = ids.tolist()
    return out


def test_every_sequence_has_its_place(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(5).write.option("parquet.block.size", 2000).parquet(f"{tmp_path}/docs")
    length, per = 16, 32
    ordered = to.read_ordered(spark, f"{tmp_path}/docs", "doc_id", "text")
    texts = [r.text for r in sorted(ordered.collect(), key=lambda r: (r.file, r.row))]
    want = stream(texts, length)
    made = []
    for size in ("4k", "128m"):  # another cut of the same files into tasks
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        folder = tmp_path / f"shards-{size}"
        to.write(to.read_ordered(spark, f"{tmp_path}/docs", "doc_id", "text"), f"file://{folder}", order=("file", "row"), length=length, per_shard=per)
        made.append(shard_files(folder))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert made[0] == made[1]
    got = sequences(made[0], length, per)
    assert sorted(got) == list(range(len(want)))
    slots = to.slots(np.arange(len(want)), len(want))
    assert all(got[int(s)] == ids for s, ids in zip(slots, want))
    # A reader that resumes at slot 3 of a shard sees what follows.
    assert [x.tolist() for x in to.read(made[0][1], 3, length)] == [got[per + k] for k in range(3, min(per, len(want) - per))]
    table = {r.slot: r for r in to.digests(spark, f"file://{tmp_path}/shards-4k", length, per).collect()}
    assert sorted(table) == sorted(got)
    for slot, ids in got.items():
        r = table[slot]
        assert (r.shard, r.position) == to.place(slot, length, per)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u2").tobytes()).hexdigest()


def test_without_files_the_order_is_that_of_ids(spark, tmp_path):
    made = []
    for n in (1, 7):
        to.write(spark.createDataFrame(ROWS, SCHEMA).repartition(n), f"file://{tmp_path}/s{n}", length=16, per_shard=32, width=4, key=9)
        made.append(shard_files(tmp_path / f"s{n}"))
    assert made[0] == made[1]
    count = sum(len(d) for d in made[0].values()) // to.stride(16, 4)
    got = {}
    for shard, data in made[0].items():
        for k, ids in enumerate(to.read(data, 0, 16, 4)):
            got[shard * 32 + k] = ids.tolist()
    ids = [i for s in to.slots(np.arange(count), count, key=9) for i in got[int(s)]]
    texts, held = [], []
    for i in ids:
        if i == 50256:
            texts.append(bpe.codec(None).decode(np.array(held, dtype="<u4").tobytes()).decode())
            held = []
        else:
            held.append(i)
    by_id = sorted({r[0] for r in ROWS if r[0] is not None})
    assert texts[0] == "no id" and texts[1] == "text number 0 " and len([t for t in texts if t]) == sum(bool(r[1]) for r in ROWS)
    assert sorted(t for t in texts if t) == sorted(r[1] for r in ROWS if r[1]) and by_id[0] == 0


def test_empty(spark, tmp_path):
    to.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert shard_files(tmp_path / "none") == {}


def test_files_of_one_name_in_partition_folders(spark, tmp_path):
    rows = [(i, f"text number {i} " * 40, i % 3) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1).write.partitionBy("k").parquet(f"{tmp_path}/docs")
    assert len({p.name for p in (tmp_path / "docs").glob("k=*/*.parquet")}) == 1
    to.write(to.read_ordered(spark, f"{tmp_path}/docs", "doc_id", "text"), f"{tmp_path}/out", order=("file", "row"), length=64, per_shard=16)
    found = sequences(shard_files(tmp_path / "out"), 64, 16)
    texts = [t for k in range(3) for i, t, kk in rows if kk == k]
    assert sorted(map(list, found.values())) == sorted(stream(texts, 64)) and sorted(found) == list(range(len(found)))


def test_a_repeated_file_name_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 0, "y")], "file string, row long, text string").repartition(2)
    with pytest.raises(ValueError, match="name a"):
        to.write(rows, f"{tmp_path}/out", order=("file", "row"), length=64)


SPACED = ["", None, " ", "  ", "a", " a  b", "a\n\n b\t\tc ", "a 　 b\x1c \x1cc", "\r\n\r\nx's  'll", "word " * 200 + "\n\n" + "word " * 200 + " end  ", "  x" * 50, "<|none|> a  <|none|>", "é  中  文😀"]


def test_ids_are_those_of_the_whole_pattern(monkeypatch):
    rng = np.random.default_rng(1)
    letters = list("ab9é中.,'s   \n\n\t\r 　\x1c\x85")
    texts = SPACED + ["".join(rng.choice(letters, n)) for n in rng.integers(0, 40, 3000)]
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in bpe.codec(None).bytes_of.items()}, special_tokens={})
    want = [whole.encode_ordinary(t or "") for t in texts]
    for least in (0, to.LEAST_PART):
        monkeypatch.setattr(to, "LEAST_PART", least)
        assert [x.tolist() for x in to.encode(pa.array(texts))] == want


def test_few_runs_of_white_space_need_no_look_ahead(monkeypatch):
    used, encoder = [], to.encoder
    monkeypatch.setattr(to, "encoder", lambda *x: used.append(x) or encoder(*x))
    texts = ["one two\nthree.", "word " * 200 + "\n\n" + "word " * 200, " ", None]
    got = list(to.encode(pa.array(texts)))
    assert used == [(None, public_tokenizers.PATTERN.replace(to.AHEAD, ""))] and used[0][1] != public_tokenizers.PATTERN
    assert [x.tolist() for x in got] == [np.frombuffer(x, dtype="<u4").tolist() for x in bpe.codec(None).encode(texts)]
