"""A kept index of three-character grams: exact keyword search that reads the lists of a query's grams and the hits only.

A gram (three code points of a lower-cased title or content, never across both) is a 63-bit number. Entries are laid down in
chunks of CHUNK at most; for each gram of a chunk there is one list of the ids that hold it, as differences in one to eight
bytes each. The table ``lists`` is partitioned by a hash of the gram into BUCKETS folders and sorted by gram within, so a query
prunes folders and row groups. In the folder ALL stands, for each chunk, the list of all its ids with their lengths.

Changed entries get chunks of their own, and the places that they had before go to the table ``gone``; both appear in one
version of a ``Store``, with the number of entries and the sum of their lengths. A search therefore sees an index of one moment.

For a token of a query, the lists of its grams are met chunk by chunk, shortest first; what is left of all lists are candidates
(grams don't tell their order), and only their texts are read and counted. Scores equal those of a scan of all entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.sources.store import Change, Store

#: Entries of a chunk, folders of the lists, the folder of lists of all ids, code points taken at once.
CHUNK, BUCKETS, ALL, HELD = 4096, 32, -1, 4_000_000
#: Files of a folder that share the lists of a gram, at least.
SPREAD = 4
#: Candidates that are sent to all tasks, at most (16 bytes each).
SENT = 500_000
BITS, MIX = 21, 0x9E3779B97F4A7C15
LISTS = "bucket int, gram long, chunk long, n int, first long, width int, steps binary, lengths binary"


def gram_codes(text: str) -> np.ndarray:
    """The number of each three neighbouring code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:] if len(c) > 2 else np.zeros(0, dtype=np.int64)


def bucket_of(grams: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((grams.astype(np.uint64) * np.uint64(MIX) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def packed(ids: np.ndarray) -> tuple[int, bytes]:
    """The differences of sorted distinct ids, in the least width that holds them all."""
    steps = np.diff(ids)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << (8 * w - (w == 8)))
    return width, steps.astype(f"<u{width}").tobytes()


def unpacked(first: int, width: int, steps: bytes) -> np.ndarray:
    out = np.empty(len(steps) // width + 1, dtype=np.int64)
    out[0] = first
    out[1:] = first + np.cumsum(np.frombuffer(steps, dtype=f"<u{width}").astype(np.int64))
    return out


class GramIndex:
    """An index of entries (id long, title, content) in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, chunk: int = CHUNK):
        self.spark, self.store, self.buckets, self.chunk = spark, Store(spark, folder), buckets, chunk

    def _lists(self, entries: DataFrame, generation: int) -> DataFrame:
        buckets, size = self.buckets, self.chunk

        def lay(batches):
            from pyspark import TaskContext

            number = (generation << 42) + (TaskContext.get().partitionId() << 21)
            for rows in _groups(batches, size):
                yield _laid(rows, number, buckets)
                number += 1

        rows = entries.select(F.col("id").cast("long"), F.lower("title").alias("title"), F.lower("content").alias("content")).where("id IS NOT NULL")
        return rows.mapInArrow(lay, LISTS)

    def _commit(self, entries: DataFrame | None, ids: DataFrame, version) -> None:
        """Put ``entries`` in place of what the index holds under ``ids``."""
        changes = {}
        if version.number:
            changes["gone"] = Change(self._places(version).join(ids, "id", "left_semi"))
        else:
            changes["gone"] = Change(self.spark.createDataFrame([], "id long, chunk long, length long"))
        if entries is not None:
            # A gram's lists of all chunks are spread over a few files of its folder, sorted by gram.
            laid = self._lists(entries, version.number + 1).repartition("bucket", F.pmod(F.xxhash64("chunk"), F.lit(SPREAD)))
            changes["lists"] = Change(laid.sortWithinPartitions("bucket", "gram", "chunk"), by=("bucket",))

        def numbers(old: dict, rows: dict[str, DataFrame]) -> dict:
            less = rows["gone"].agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            more = rows["lists"].where(F.col("bucket") == ALL).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("gram"), F.lit(0))).first() if "lists" in rows else (0, 0)
            return {"entries": old.get("entries", 0) + int(more[0]) - int(less[0]), "length": old.get("length", 0) + int(more[1]) - int(less[1])}

        self.store.commit(changes, reads=["lists", "gone"], since=version, numbers=numbers)

    def _places(self, version) -> DataFrame:
        """(id, chunk, length) of all entries that stand in the index."""

        def rows(batches):
            for batch in batches:
                for chunk, first, width, steps, lengths in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    ids = unpacked(first, width, steps)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), chunk)), pa.array(np.frombuffer(lengths, dtype="<u4").astype(np.int64))], names=["id", "chunk", "length"])

        listed = self.store.read("lists", version).where(F.col("bucket") == ALL).select("chunk", "first", "width", "steps", "lengths")
        return listed.mapInArrow(rows, "id long, chunk long, length long").join(self.store.read("gone", version).select("id", "chunk"), ["id", "chunk"], "left_anti")

    def upsert(self, entries: DataFrame) -> None:
        """Add entries, or put them in place of those of the same id (ids of ``entries`` are distinct). Reads the changed entries only."""
        version = self.store.version()
        self._commit(entries, entries.select(F.col("id").cast("long").alias("id")), version)

    def delete(self, ids: DataFrame) -> None:
        """Take the entries with the given ids (a column ``id``) out."""
        version = self.store.version()
        if version.number:
            self._commit(None, ids.select(F.col("id").cast("long").alias("id")), version)

    def candidates(self, tokens: list[str], version) -> DataFrame:
        """(id, tokens): for entries that may hold some of the ``tokens``, the numbers of these (an array). Reads the lists of the tokens' grams."""
        codes = [np.unique(gram_codes(t)) for t in tokens]
        every = np.unique(np.concatenate(codes))
        places = [np.searchsorted(every, c).tolist() for c in codes]
        named = every.tolist()

        def meet(group):
            lists: dict[int, list[np.ndarray]] = {}
            for gram, first, width, steps in zip(*(group.column(c).to_pylist() for c in ("gram", "first", "width", "steps"))):
                lists.setdefault(gram, []).append(unpacked(first, width, steps))
            found: dict[int, list[int]] = {}
            for i, mine in enumerate(places):
                if not all(named[p] in lists for p in mine):
                    continue
                arrays = sorted((np.concatenate(lists[named[p]]) for p in mine), key=len)
                ids = arrays[0]
                for other in arrays[1:]:
                    if not len(ids):
                        break
                    ids = np.intersect1d(ids, other, assume_unique=True)
                for x in ids.tolist():
                    found.setdefault(x, []).append(i)
            chunk = group.column("chunk")[0].as_py()
            return pa.table({"id": pa.array(list(found), pa.int64()), "chunk": pa.array([chunk] * len(found), pa.int64()), "tokens": pa.array(list(found.values()), pa.list_(pa.int32()))})

        wanted = F.col("gram").isin(named) & F.col("bucket").isin(sorted(set(bucket_of(every, self.buckets).tolist())))
        lists = self.store.read("lists", version).where(wanted).select("chunk", "gram", "first", "width", "steps")
        met = lists.groupBy("chunk").applyInArrow(meet, "id long, chunk long, tokens array<int>")
        return met.join(self.store.read("gone", version).select("id", "chunk"), ["id", "chunk"], "left_anti").select("id", "tokens")

    def longest_list(self, tokens: list[str], version) -> int:
        """Most candidates that any of the tokens can have: the entries of its rarest gram, summed over the tokens."""
        codes = [np.unique(gram_codes(t)) for t in tokens]
        every = np.unique(np.concatenate(codes))
        wanted = F.col("gram").isin(every.tolist()) & F.col("bucket").isin(sorted(set(bucket_of(every, self.buckets).tolist())))
        counts = dict(self.store.read("lists", version).where(wanted).groupBy("gram").agg(F.sum("n")).collect())  # a row for each gram of the query
        return sum(min(counts.get(g, 0) for g in c.tolist()) for c in codes)


def _groups(batches, size: int):
    """Rows of a chunk: ``size`` entries, or as many as hold HELD code points."""
    rows, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for row in zip(*(part.column(i).to_pylist() for i in range(3))):
                rows.append(row)
                held += len(row[1] or "") + len(row[2] or "")
                if len(rows) >= size or held >= HELD:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def _laid(rows: list[tuple], number: int, buckets: int) -> pa.RecordBatch:
    """The lists of one chunk, and the list of all its ids. The latter's gram holds the sum of lengths."""
    rows = sorted(rows, key=lambda r: r[0])
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    lengths = np.array([sum(max(0, len(t or "") - 2) for t in r[1:]) for r in rows], dtype=np.int64)
    codes, owner = [], []
    for i, row in enumerate(rows):
        own = np.unique(np.concatenate([gram_codes(row[1] or ""), gram_codes(row[2] or "")]))
        codes.append(own)
        owner.append(np.full(len(own), i, dtype=np.int32))
    code, who = np.concatenate(codes), np.concatenate(owner)
    order = np.argsort(code, kind="stable")  # within a gram by id, as rows are sorted
    code, who = code[order], ids[who[order]]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(first[1:], len(code))
    grams = code[first]
    made = [packed(who[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
    width, steps = packed(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(bucket_of(grams, buckets), np.int32(ALL))),
            pa.array(np.append(grams, lengths.sum())),
            pa.array(np.full(len(grams) + 1, number)),
            pa.array(np.append(ends - first, len(ids)).astype(np.int32)),
            pa.array(np.append(who[first], ids[0])),
            pa.array([*(w for w, _ in made), width], pa.int32()),
            pa.array([*(s for _, s in made), steps], pa.binary()),
            pa.array([None] * len(grams) + [lengths.astype("<u4").tobytes()], pa.binary()),
        ],
        names=[c.split()[0] for c in LISTS.split(", ")],
    )
