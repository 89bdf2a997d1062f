"""Shards of near-equal bytes by histogram sort: probe, count exactly, refine, and exchange once.

Rows are ordered by a key of 192 bits: the hash of the text, the id, and the row's place in the scan. Equal texts are
neighbours, and even a single text or id with a third of all rows can be cut. A narrow table of keys and sizes is written
once. Each round then counts, over all of it, the bytes between candidate boundaries (probes), with the least and greatest key
that occurs between two of them; the driver keeps the interval around each boundary's target and lays new probes into it, on
borders between texts as long as the interval holds several texts, then on borders between ids, then rows. A boundary is found
when the bytes below it are within the tolerance of its target, or when one row is all that is left between its neighbours. So
a group of equal texts is cut only if it is larger than the tolerance and stands at a boundary. Then the texts move, once.

A shard is written as one or more parts of some PART_BYTES, each by a task of its own: the boundaries of parts are found in the
same rounds with a wider tolerance, so a task's share doesn't grow with the input. The driver sees a few thousand counts a
round and the boundaries, at most MOST_PARTS of them.

Defined results
* size of a row: UTF-8 bytes of its text (null: none) and OVERHEAD. Null and empty texts are groups of equal texts like others.
* ties and repeated rows: rows that agree in text and id are interchangeable; they are cut by their place in the scan.
* very long texts stay whole: a shard is off its share by half the text at its border at most, beside the tolerance.
* empty tables give no rows. Input columns called like an added one (shard, part, place, slot) are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quern.llm.shared import drop_folder, shared_folder, table

SHARDS, OVERHEAD = 24, 8
#: Tolerance of a shard's boundary, in shards; of a part's, in parts.
TOLERANCE, PART_TOLERANCE = 0.005, 0.1
#: Bytes of text that a task writes, about, and parts at most.
PART_BYTES, MOST_PARTS = 128 << 20, 50_000
#: Candidate boundaries counted in a round, about, and for each open boundary at least.
PROBES, LEAST_PROBES = 4096, 8
WIDTH, SIGN = 24, np.uint64(1 << 63)
COUNTED = "bucket long, bytes decimal(38,0), low binary, high binary"


def pack(*parts: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes, in byte order that of the signed 64-bit columns."""
    out = np.empty((len(parts[0]), len(parts)), dtype=">u8")
    for j, x in enumerate(parts):
        out[:, j] = x.astype(np.int64, copy=False).view(np.uint64) ^ SIGN
    return out.view(f"S{8 * len(parts)}").ravel()


def as_int(key: bytes) -> int:
    return int.from_bytes(key.ljust(WIDTH, b"\0"), "big")


def as_bytes(key: int) -> bytes:
    return key.to_bytes(WIDTH + 1, "big")[1:] if key < 1 << 8 * WIDTH else b"\xff" * WIDTH


class Boundary:
    """One boundary between parts: the interval [low, high) of keys in which it lies, and the bytes below both ends."""

    def __init__(self, target: int, tolerance: int, total: int):
        self.target, self.tolerance = target, tolerance
        self.low, self.below, self.high, self.upto = 0, 0, 1 << 8 * WIDTH, total
        #: Least and greatest key inside, once counted.
        self.first, self.last = 0, (1 << 8 * WIDTH) - 1
        self.found: int | None = None

    def settle(self) -> bool:
        """Take an end of the interval if it is near enough, or if nothing is between the ends that could be cut."""
        before, after = self.target - self.below, self.upto - self.target
        if min(before, after) <= self.tolerance or self.first == self.last:
            self.found = self.low if before <= after else self.high
        return self.found is not None

    def probes(self, count: int) -> list[int]:
        """Keys in (first, last] that cut the interval: on borders of texts if it holds several, else of ids, else of rows."""
        shift = next(s for s in (128, 64, 0) if self.first >> s != self.last >> s)
        a, b = self.first >> shift, self.last >> shift
        return sorted({(a + max(1, (b - a) * i // count)) << shift for i in range(1, count + 1)})


def boundaries(keys: DataFrame, targets: list[tuple[int, int]], total: int, probes: int = PROBES) -> list[int]:
    """Splitters of ``keys`` (h, d, t, size), each as near to its (target, tolerance) in bytes as asked for, or as a row allows."""
    asked = [Boundary(t, tolerance, total) for t, tolerance in targets]
    open_ = [b for b in asked if not b.settle()]
    while open_:
        each = max(LEAST_PROBES, probes // len(open_))
        # Neighbours often share an interval; its probes are counted once.
        intervals = {(b.low, b.high): b for b in open_}
        grid = sorted({x for b in intervals.values() for x in (b.low, min(b.high, (1 << 8 * WIDTH) - 1), *b.probes(each))})
        # What lies from one probe to the next, exactly.
        found = {int(r[0]): r for r in histogram(keys, grid).collect()}
        sums = [0] * (len(grid) + 1)
        for bucket, r in found.items():
            sums[bucket] = int(r[1])
        at = {x: i for i, x in enumerate(grid)}
        for b in open_:
            i, below = at[b.low], b.below
            top = (1 << 8 * WIDTH) if b.high == 1 << 8 * WIDTH else b.high
            while True:  # on to the bucket that the target is in
                end = grid[i + 1] if i + 1 < len(grid) else top
                inside = sums[i + 1]
                if below + inside >= b.target or end >= top:
                    break
                below, i = below + inside, i + 1
            row = found.get(i + 1)
            b.low, b.below, b.high, b.upto = grid[i], below, end, below + inside
            b.first, b.last = (as_int(bytes(row[2])), as_int(bytes(row[3]))) if row else (b.low, b.low)
        open_ = [b for b in open_ if not b.settle()]
    return [b.found for b in asked]


def histogram(keys: DataFrame, grid: list[int]) -> DataFrame:
    """(bucket, bytes, low, high) of the keys: bucket i holds those from grid[i - 1] to below grid[i]; empty buckets are left out."""
    edges = np.array([as_bytes(x) for x in grid], dtype=f"S{WIDTH}")

    def count(batches):
        total = np.zeros(len(edges) + 1, dtype=np.int64)
        ends: dict[int, list[bytes]] = {}
        for batch in batches:
            h, d, t, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            key = pack(h, d, t)
            order = np.argsort(key)
            key, size = key[order], size[order]
            bucket = np.searchsorted(edges, key, side="right")
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            if not len(first):
                continue
            which = bucket[first]
            total[which] += np.add.reduceat(size, first)
            last = np.append(first[1:], len(key)) - 1
            for w, a, b in zip(which.tolist(), key[first].tolist(), key[last].tolist()):
                a, b = a.ljust(WIDTH, b"\0"), b.ljust(WIDTH, b"\0")
                if w in ends:
                    ends[w] = [min(a, ends[w][0]), max(b, ends[w][1])]
                else:
                    ends[w] = [a, b]
        which = list(ends)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int64()), pa.array([int(total[w]) for w in which], pa.int64()), pa.array([ends[w][0] for w in which], pa.binary()), pa.array([ends[w][1] for w in which], pa.binary())],
            names=["bucket", "bytes", "low", "high"],
        )

    made = keys.select("h", "d", "t", "size").mapInArrow(count, "bucket long, bytes long, low binary, high binary")
    return made.groupBy("bucket").agg(F.sum(F.col("bytes").cast("decimal(38,0)")).alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with its key (__h, __d, __t) and size."""
    text, ident = docs[text_col], docs[id_col]
    number = ident.cast("long") if docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(ident)
    return docs.withColumns(
        {
            "__h": F.xxhash64(F.coalesce(text, F.lit(""))),
            "__d": F.coalesce(number, F.lit(-(1 << 63))),
            "__t": F.monotonically_increasing_id(),
            "__size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD,
        }
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, probes: int = PROBES) -> StructType:
    """Write ``docs`` to ``folder`` as Parquet, a folder for each of ``shards``, in the order of keys; the schema that ``read_shards`` takes."""
    spark = docs.sparkSession
    added = ("shard", "part", "place", "slot", "__h", "__d", "__t", "__size")
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in added])
    keyed = with_keys(docs, id_col, text_col)
    kept = f"{shared_folder(spark)}/sharding-keys-{uuid.uuid4().hex}"
    keyed.select(F.col("__h").alias("h"), F.col("__d").alias("d"), F.col("__t").alias("t"), F.col("__size").alias("size")).write.parquet(kept)
    try:
        keys = spark.read.schema("h long, d long, t long, size long").parquet(kept)
        total = int(keys.agg(F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0))).first()[0])
        each = max(1, min(-(-total // (shards * part_bytes)), MOST_PARTS // shards))
        parts = shards * each
        near, nearer = int(total * PART_TOLERANCE / parts), int(total * tolerance / shards)
        targets = [(total * k // parts, near if k % each else nearer) for k in range(1, parts)]
        cuts = np.array([as_bytes(x) for x in sorted(boundaries(keys, targets, total, probes))], dtype=f"S{WIDTH}")
    finally:
        drop_folder(spark, kept)

    @F.arrow_udf("int")
    def part_of(h: pa.Array, d: pa.Array, t: pa.Array) -> pa.Array:
        key = pack(*(x.to_numpy(zero_copy_only=False) for x in (h, d, t)))
        return pa.array(np.searchsorted(cuts, key, side="right").astype(np.int32))

    placed = keyed.withColumn("part", part_of("__h", "__d", "__t")).repartitionById(parts, "part")
    placed = placed.withColumn("shard", F.floor(F.col("part") / each).cast("int")).sortWithinPartitions("shard", "__h", "__d", "__t")
    # A part is a partition now: the low 33 bits are the row's place in it.
    placed = placed.withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    made = placed.drop("__h", "__d", "__t", "__size")
    made.write.mode("overwrite").partitionBy("shard").parquet(folder)
    return made.schema


def read_shards(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of ``write_shards`` with shard and slot (from 0, without gaps, in the order of keys)."""
    rows = spark.read.schema(schema).parquet(folder)
    # One row a part, MOST_PARTS at most.
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = sizes.select(F.col("part").alias("__part"), before.alias("__before"))
    return rows.join(F.broadcast(offsets), rows["part"] == offsets["__part"]).withColumn("slot", F.col("place") + F.col("__before")).drop("part", "place", "__part", "__before")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of documents while it is built; the result reads them."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    schema = write_shards(table(spark, sf_dir, "documents"), folder)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, folder, schema).select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op11_sharding": op11_sharding}
