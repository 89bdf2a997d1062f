"""Token ids in training order: a keyed Feistel permutation gives every sequence a global slot, shards hold fixed strides.

1. Texts are encoded, an end id closes each, and the ids of all texts follow one another as one stream in the order of the
   rows; the stream is cut into sequences of LENGTH ids, and end ids fill up the last one.
2. The order of rows is that of files and rows within them (see ``read_ordered``); a table without files is first written to
   the shared folder, sorted by id and text. Neither depends on splits or tasks, so the same table and key give the same
   shards on any cluster. A first pass counts the ids of each segment (a run of neighbouring rows of a file in one task: a
   few dozen bytes for each split of the input are summed on the driver), a second one encodes again and knows where in the
   stream it stands. To encode twice takes less than to keep all ids in between, which would cost 0.8 times the input on disk.
3. The slot of a sequence is a balanced Feistel network of ROUNDS keyed rounds over the smallest even number of bits that
   holds n, walked along its cycle until it falls below n: a permutation of the slots without any shuffle or sort of keys.
4. Sequences are dealt to tasks by ranges of slots, sorted by slot and written as raw files, PER_SHARD sequences each, one
   folder a shard. Each sequence is followed by one id's width of line ends (the text sink's record mark, as it is the sink
   of Spark that writes bytes as they are). So sequence i of a shard stands at byte i * stride(): a reader resumes at any
   slot by arithmetic alone and reads on sequentially.

Defined results
* null and empty texts give their end id only; repeated rows are texts of their own. Very long texts give many sequences.
* ids below 65536 take two bytes each, little-endian; a vocabulary beyond that takes four.
* another key gives another order. Empty tables give no shard. Rows without an id are like others; ids may repeat.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid
from contextlib import contextmanager
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.bpe import SPACES, default_ranks_path
from quern.llm.shared import drop_folder, mix64, shared_folder

LENGTH, PER_SHARD, ROUNDS, KEY, END = 512, 4096, 6, 20_240_229, 50256
#: Shards that a task writes, about, and tasks at most.
SHARDS_PER_TASK, MOST_TASKS = 4, 20_000
#: The part of the pre-tokenizer pattern that looks ahead, white space that it is for, and characters of a part of a text at least, on average.
AHEAD, RUN, LEAST_PART = r"|\s+(?!\S)", f"[{SPACES}][{SPACES}]", 100


def round_keys(key: int, rounds: int = ROUNDS) -> np.ndarray:
    return mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & (1 << 63) - 1) + np.uint64(key))


def slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of the sequences numbered ``index``, all below ``n``: a permutation of 0 .. n - 1."""
    if n <= 1:
        return np.zeros(len(index), dtype=np.int64)
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = round_keys(key, rounds)
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        out[todo] = x = left << half | right
        todo = todo[x >= n]  # walk on along the cycle
    return out.astype(np.int64)


def stride(length: int = LENGTH, width: int = 2) -> int:
    """Bytes from one sequence of a shard to the next."""
    return (length + 1) * width


def place(slot: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> tuple[int, int]:
    """(shard, byte offset) of a slot."""
    return slot // per_shard, slot % per_shard * stride(length, width)


def read(data: bytes, first: int = 0, length: int = LENGTH, width: int = 2):
    """The sequences of a shard file from the ``first`` on, without a look at those before."""
    step = stride(length, width)
    for at in range(first * step, len(data), step):
        yield np.frombuffer(data, dtype="<u2" if width == 2 else "<u4", count=length, offset=at)


@lru_cache(4)
def encoder(ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file, loaded once per Python worker."""
    with open(ranks_path or default_ranks_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # encode_to_numpy needs a special token to look for; as none is ever allowed, its name in a text is text like any other.
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|none|>": max(ranks.values()) + 1})


def encode(texts: pa.Array, ranks_path: str | None = None):
    """An array of ids for each text, as ``encoder`` gives them, by an expression without a look ahead, which takes some two thirds of the time.

    The look ahead of the pre-tokenizer pattern does one thing: where white space of several characters stands before
    something else, its last character goes with what follows. So the text is cut before that character and each part
    is encoded for itself; single white space needs no cut. Where the parts are many, the pattern itself costs less.
    """
    plain = encoder(ranks_path, public_tokenizers.PATTERN.replace(AHEAD, ""))
    for text, run in zip(texts.to_pylist(), pc.match_substring_regex(texts, RUN).to_pylist()):
        cuts = [m.end() - 1 for m in re.finditer(f"{RUN}+", text) if m.end() < len(text)] if run else []
        if len(cuts) * LEAST_PART > len(text or ""):
            yield encoder(ranks_path).encode_to_numpy(text, disallowed_special=())
        elif cuts:
            yield np.concatenate([plain.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in pairwise([0, *cuts, len(text)])])
        else:
            yield plain.encode_to_numpy(text or "", disallowed_special=())


@contextmanager
def _same_splits(spark: SparkSession):
    """Both passes cut the files alike, even if executors come or go in between."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _segments(batches, ranks_path: str | None, end: int):
    """(file, first row, ids before in the segment, arrays of ids) of a few neighbouring texts at a time."""
    last, first, seen, close = None, 0, 0, np.array([end], dtype=np.uint32)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held = []
            for file, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2), ranks_path)):
                if last != (file, row - 1):
                    if held:
                        yield last[0], first, seen, held
                    first, seen, held = row, 0, []
                last = (file, row)
                held += ids, close
            if held:
                yield last[0], first, seen, held
                seen += sum(map(len, held))


def in_order(rows: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END, width: int = 2, ranks_path: str | None = None) -> DataFrame:
    """(shard, slot, ids) of ``rows`` (file, row, text): one row a sequence, whole shards in a task, in the order of slots."""

    def count(batches):
        found: dict[tuple, int] = {}
        for file, first, seen, held in _segments(batches, ranks_path, end):
            found[file, first] = seen + sum(map(len, held))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["file", "segment", "n"])

    # One row a segment; the order of files and of segments within them is that of the stream.
    offsets, total = {}, 0
    for file, segment, size in sorted(tuple(r) for r in rows.mapInArrow(count, "file string, segment long, n long").collect()):
        if (file, segment) in offsets:
            raise ValueError(f"two files go by the name {file}")
        offsets[file, segment], total = total, total + size
    n = -(-total // length)
    shared = rows.sparkSession.sparkContext.broadcast(offsets)

    def pieces(batches):
        kind = "<u2" if width == 2 else "<u4"
        for file, first, seen, held in _segments(batches, ranks_path, end):
            data = np.concatenate(held).astype(kind)
            low = shared.value[file, first] + seen
            high = low + len(data)
            number = np.arange(low // length, -(-high // length))
            cuts = np.clip(np.append(number, number[-1] + 1) * length, low, high) - low
            binary = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data.tobytes())])
            within = np.maximum(low - number * length, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slots(number, n, key)), pa.array(within), binary], names=["slot", "within", "ids"])

    def whole(batches):
        """Pieces of one sequence, neighbours now, are put together; end ids fill up the last sequence of the stream."""
        size, fill = length * width, np.full(length, end, dtype="<u2" if width == 2 else "<u4").tobytes()
        held, parts = None, []
        made: list[tuple[int, bytes]] = []

        def flush():
            rows = [(s, x if len(x) == size else x + fill[len(x) :]) for s, x in made]
            made.clear()
            at = np.array([s for s, _ in rows], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at // per_shard), pa.array(at), pa.array([x for _, x in rows], pa.binary())], names=["shard", "slot", "ids"])

        for batch in batches:
            for slot, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot == held:
                    parts.append(piece)
                    continue
                if held is not None:
                    made.append((held, b"".join(parts)))
                held, parts = slot, [piece]
                if len(made) >= 2000:
                    yield flush()
        if held is not None:
            made.append((held, b"".join(parts)))
        if made:
            yield flush()

    shards = max(1, -(-n // per_shard))
    each = max(SHARDS_PER_TASK, -(-shards // MOST_TASKS))
    laid = rows.mapInArrow(pieces, "slot long, within int, ids binary")
    task = F.floor(F.col("slot") / F.lit(per_shard * each)).cast("int")
    dealt = laid.repartitionById(-(-shards // each), task).sortWithinPartitions("slot", "within")
    return dealt.select("slot", "ids").mapInArrow(whole, "shard long, slot long, ids binary").sortWithinPartitions("shard", "slot")


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, str] | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end: int = END, width: int = 2, ranks_path: str | None = None) -> None:
    """Write the shards of ``docs`` to ``folder``; a rerun writes the same bytes. order: the columns that hold a row's file and its number there; its files must be read whole."""
    spark, kept = docs.sparkSession, None
    if order:
        rows = docs.select(F.col(order[0]).cast("string").alias("file"), F.col(order[1]).cast("long").alias("row"), F.col(text_col).alias("text"))
    else:
        kept = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
        keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
        keyed.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("text").write.option("maxRecordsPerFile", 0).parquet(kept)
        rows = read_ordered(spark, kept, "text").select("file", "row", "text")
    try:
        with _same_splits(spark):
            ordered = in_order(rows, length, per_shard, key, end, width, ranks_path)
            # A binary column cast to string keeps its bytes, and the text sink writes them unchanged.
            ordered.select("shard", F.col("ids").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").option("lineSep", "\n" * width).text(folder)
    finally:
        if kept:
            drop_folder(spark, kept)


def read_ordered(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table with the columns ``file`` and ``row`` that ``write`` takes as order. Files go by their whole path: those of one task have one name in all partition folders."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digests(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> DataFrame:
    """(slot, shard, position, ids_sha256) of the shard files in ``folder``: position is the byte at which a sequence stands."""
    step = stride(length, width)

    def sums(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                at = np.arange(0, len(data), step)
                first = [pa.array(x) for x in (shard * per_shard + at // step, np.full(len(at), shard), at)]
                yield pa.RecordBatch.from_arrays([*first, pa.array([sha256(data[k : k + length * width]).hexdigest() for k in at.tolist()], pa.string())], names=["slot", "shard", "position", "ids_sha256"])

    files = spark.read.format("binaryFile").load(folder).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInArrow(sums, "slot long, shard long, position long, ids_sha256 string")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/training-shards-{uuid.uuid4().hex}"
    write(read_ordered(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"), folder, order=("file", "row"))
    return digests(spark, folder)


QUERIES = {"op1_training_order": op1_training_order}
