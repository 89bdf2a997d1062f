"""Collocations by level-wise counts in minimal perfect hash tables.

Phrases of k words are told by one number: the slot of their first k - 1 words in the table of the level below, times the
number of frequent words, plus the slot of the last word. So a key is exact at every level, and languages never mix, as slots
of words are those of (language, word).

1. Words are counted; those with MIN_COUNT or more get slots in a minimal perfect hash. The corpus is rewritten as arrays of
   slots, in which one -1 stands for whatever separates: the end of a piece or of a text, or rarer words (no phrase with such a
   word can be frequent).
2. At level k an occurrence is a candidate only if its first and its last k - 1 words are frequent (Apriori). Tasks send the
   keys of their candidates, once a block, with a count that stops at MIN_COUNT: one byte each, enough to tell who reaches
   MIN_COUNT in all. Keys go in arrays by parts of a hash, as many as keep a part small. Those keys get a minimal perfect hash.
3. Each occurrence is looked up: the hash gives a slot for any key, and the key stored there tells whether it is meant. Slots
   replace those of the level below; what can be part of no longer candidate goes.
4. Tasks bincount slots into arrays by cells of CELL slots; arrays are summed cell by cell in a tree of fan-in FAN_IN.
   All cuts of a phrase are then read by slot.

Tables are built, shipped and looked up in slices of TABLE_KEYS keys at most, one after the other, so memory is bounded
whatever the number of phrases; each slice is a pass over the arrays that are left.

Defined results
* null and empty texts: no words. A language that is null counts as UNKNOWN.
* ties: as in ``collocations``. Repeated rows count as often as they stand there. Other columns are not read.
* very long texts: an array of slots each. Languages without a phrase give no row; an empty table gives no row.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.shared import drop_folder, mix64, shared_folder, small_batches, table

MIN_COUNT, LONGEST, TOP, COVERED, UNKNOWN = 30, 4, 2000, 80, "und"
SCALE = 2_000_000
#: Words of a block; distinct words that a task counts before it sends them.
BLOCK_WORDS, HELD_WORDS = 200_000, 100_000
#: Slots in a row of the rewritten corpus (two arrays of 8 bytes each), keys that a task sorts out before it sends them.
ROW_WORDS, HELD_KEYS = 24_000, 400_000
#: Bytes of text whose words, and words of the corpus whose keys, are summed in one group, about.
PART_BYTES, PART_KEYS = 16 << 20, 3_000_000
#: Rows of a batch that are taken at once.
ROWS = 1000
#: Keys of a slice of a table (some 40 MB), slots of a cell, arrays summed at once, cells that a task holds.
TABLE_KEYS, CELL, FAN_IN, HELD_CELLS = 4_000_000, 1 << 14, 32, 512
#: Parts that a language's phrases are ranked in before they are ranked together.
RANKED_IN = 64

#: A-Z lower-cased, the characters that end a piece made full stops, tabs made spaces.
_FOLD = bytearray(range(256))
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 46
_FOLD[9] = 32
FOLD = bytes(_FOLD)
END = b"."


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, with END wherever a piece ends."""
    return text.translate(FOLD).replace(END, b" . ").split() if text else []


class MinimalHash:
    """A minimal perfect hash of distinct 64-bit keys: on each level keys that meet no other claim a bit, the rest go on; a key's slot is the rank of its bit."""

    ROOM = 2

    def __init__(self, keys: np.ndarray):
        left, self.sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            size = max(64, -(-self.ROOM * len(left) // 64) * 64)
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        whole = np.concatenate(bits) if bits else np.zeros(64, dtype=bool)
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A key's own slot, any slot or -1 for what is no key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        keys = keys.astype(np.uint64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = base + self._place(keys[todo], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(lower)
            todo = todo[~hit]
            base += size
        return out


class KeyTable:
    """Slots of numbers, each checked against the number stored in its slot."""

    def __init__(self, keys: np.ndarray):
        self.hash = MinimalHash(keys)
        self.stored = np.empty(len(keys), dtype=np.int64)
        self.stored[self.hash.slots(keys)] = keys

    def __len__(self) -> int:
        return len(self.stored)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self.hash.slots(keys)
        slots[(slots >= 0) & (self.stored[slots] != keys)] = -1
        return slots


class WordTable:
    """Slots of byte strings, each checked against the string stored in its slot."""

    def __init__(self, words: list[bytes]):
        self.seed = 0
        while len(np.unique(keys := self._keys(words))) < len(words):
            self.seed += 1
        self.hash = MinimalHash(keys)
        order = np.empty(len(words), dtype=np.int64)
        order[self.hash.slots(keys)] = np.arange(len(words))
        self.stored = b"".join(words[i] for i in order.tolist())
        self.starts = np.cumsum([0, *(len(words[i]) for i in order.tolist())])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, slot: int) -> bytes:
        return self.stored[self.starts[slot] : self.starts[slot + 1]]

    def _keys(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in words), dtype=np.uint64, count=len(words))

    def find(self, words: list[bytes]) -> np.ndarray:
        slots = self.hash.slots(self._keys(words))
        starts, ends = self.starts[slots].tolist(), self.starts[slots + 1].tolist()
        stored = self.stored
        meant = np.fromiter((stored[a:b] == w for a, b, w in zip(starts, ends, words)), dtype=bool, count=len(words))
        slots[~meant] = -1
        return slots


def squeezed(keep: np.ndarray) -> np.ndarray:
    """Places to take: all that are kept, and the first of each stretch of others."""
    stays = keep.copy()
    stays[0] = True
    stays[1:] |= keep[:-1]
    return np.flatnonzero(stays)


def cut_places(w: np.ndarray) -> np.ndarray:
    """Where to cut an array of slots, behind a -1, into rows of some ROW_WORDS."""
    ends = np.flatnonzero(w < 0) + 1
    at = np.searchsorted(ends, np.arange(ROW_WORDS, len(w), ROW_WORDS))
    return np.unique(ends[at[at < len(ends)]])


class Corpus:
    """A text column as arrays of slots, and the tables of all levels, in a folder of the shared one."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
        self.folder = f"{shared_folder(self.spark)}/collocations-{uuid.uuid4().hex}"
        self.min_count, self.longest = min_count, longest
        #: Words with a slot, and all occurrences of words.
        self.width, self.total = 0, 0

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _tables(self, keys: DataFrame, name: str, build) -> list[int]:
        """Lay ``keys`` out in tables, a slice each; the first slot of each slice, and the number of all."""
        slices = max(1, -(-keys.count() // TABLE_KEYS))
        columns = keys.columns

        def lay(group):
            made = build([group.column(c) for c in columns])
            return pa.table({"slice": group.column("slice")[:1], "n": pa.array([len(made)], pa.int64()), "blob": pa.array([pickle.dumps(made, 5)], pa.binary())})

        dealt = keys.withColumn("slice", F.pmod(F.xxhash64(*columns), F.lit(slices)).cast("int"))
        blobs = self._kept(dealt.groupBy("slice").applyInArrow(lay, "slice int, n long, blob binary"), f"tables-{name}")
        sizes = dict(blobs.select("slice", "n").collect())
        return np.cumsum([0, *(sizes.get(i, 0) for i in range(slices))]).tolist()

    def _table(self, name: str, i: int):
        rows = self.spark.read.parquet(f"{self.folder}/tables-{name}").where(F.col("slice") == i).select("blob").collect()
        return self.spark.sparkContext.broadcast(pickle.loads(rows[0][0]) if rows else None)

    def words(self) -> tuple[DataFrame, DataFrame]:
        """(lang, n) and (slot, lang, word, n) of the frequent words; lays out their table."""

        parts = max(1, -(-int(self.docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // PART_BYTES))
        enough = self.min_count

        def count(batches):
            held = defaultdict(Counter)

            def sent():
                for lang, found in held.items():
                    found.pop(END, None)
                    dealt: dict[int, list[bytes]] = defaultdict(list)
                    for w in found:
                        dealt[xxhash.xxh64_intdigest(w) % parts].append(w)
                    for part, words in dealt.items():
                        yield _record(part=(part, pa.int32()), lang=(lang, pa.string()), words=(b" ".join(words), pa.binary()), counts=(np.array([found[w] for w in words], dtype=np.int64).tobytes(), pa.binary()))
                held.clear()

            for batch in _slices(batches):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held[lang].update(words_of(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from sent()
            yield from sent()

        def add(group):
            """Frequent words of a part, and for each language a row without a word that has the count of all."""
            found: dict[str, dict[bytes, int]] = defaultdict(dict)
            for lang, words, counts in zip(group.column("lang").to_pylist(), group.column("words"), group.column("counts")):
                own = found[lang]
                for w, n in zip(words.as_py().split(b" "), np.frombuffer(counts.as_buffer(), dtype=np.int64).tolist()):
                    own[w] = own.get(w, 0) + n
            rows = [(lang, None, sum(own.values())) for lang, own in found.items()]
            rows += [(lang, w, n) for lang, own in found.items() for w, n in own.items() if n >= enough]
            return pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

        sent = self.docs.mapInArrow(count, "part int, lang string, words binary, counts binary")
        counts = self._kept(sent.groupBy("part").applyInArrow(add, "lang string, word binary, n long"), "words")
        totals = counts.where("word IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        often = counts.where("word IS NOT NULL")
        self.total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        whole = F.concat(F.col("word"), F.lit(b" "), F.col("lang").cast("binary"))  # a word holds no space
        self.starts = {1: self._tables(often.select(whole.alias("word")), "1", lambda c: WordTable(c[0].to_pylist()))}
        self.width = max(1, self.starts[1][-1])
        named = self._slots("1", self.starts[1], lambda t: pa.array([t[i] for i in range(len(t))], pa.binary()), "binary")
        return totals, named.join(often.select(whole.alias("key"), "lang", F.col("word").cast("string").alias("word"), "n"), "key").select("slot", "lang", "word", "n")

    def _slots(self, name: str, starts: list[int], keys_of, kind: str) -> DataFrame:
        """(slot, key) of a level's tables."""

        def rows(batches):
            for batch in batches:
                for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys = keys_of(pickle.loads(blob))
                    slots = pa.array(np.arange(len(keys)) + starts[i])
                    for at in range(0, len(keys), 100_000):
                        yield pa.RecordBatch.from_arrays([slots[at : at + 100_000], keys[at : at + 100_000]], names=["slot", "key"])

        return self.spark.read.parquet(f"{self.folder}/tables-{name}").select("slice", "blob").mapInArrow(rows, f"slot long, key {kind}")

    def encode(self) -> DataFrame:
        """The corpus as rows of (w, s), both arrays of the slots of its words."""
        starts, docs = self.starts[1], self.docs.withColumn("ids", F.lit(None).cast("binary"))
        for i in range(len(starts) - 1):
            shared, base, last = self._table("1", i), starts[i], i == len(starts) - 2

            def slots(rows):
                """Arrays of the texts of a block, where the words of this slice have got their slots."""
                seen, arrays, words = shared.value, [], {}
                for lang, text, _ in rows:
                    if lang not in words:
                        words[lang] = defaultdict()
                        words[lang].default_factory = words[lang].__len__
                    found = words_of(text)
                    arrays.append(np.fromiter(map(words[lang].__getitem__, found), dtype=np.int64, count=len(found)))
                known = {}
                for lang, found in words.items():
                    tail = b" " + lang.encode()
                    at = seen.find([w + tail for w in found]) if seen else np.full(len(found), -1)
                    known[lang] = np.where(at >= 0, at + base, -1)
                for (lang, _, ids), array in zip(rows, arrays):
                    new = known[lang][array] if len(array) else array
                    yield new if ids is None else np.where(new >= 0, new, np.frombuffer(ids, dtype=np.int64))

            def blocks(batches):
                """A few texts at a time."""
                rows, size = [], 0
                for batch in _slices(batches):
                    for row in zip(*(batch.column(c).to_pylist() for c in range(3))):
                        rows.append(row)
                        size += len(row[1] or b"") // 6
                        if size >= BLOCK_WORDS:
                            yield rows
                            rows, size = [], 0
                if rows:
                    yield rows

            def filled(batches):
                for rows in blocks(batches):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([x.tobytes() for x in slots(rows)], pa.binary())], names=["lang", "text", "ids"])

            def joined(batches):
                border = np.array([-1])
                for rows in blocks(batches):
                    w = np.concatenate([x for array in slots(rows) for x in (array, border)])
                    w = w[squeezed(w >= 0)].astype(np.int64)
                    for piece in np.split(w, cut_places(w)):
                        yield from _row(piece, piece)

            made = docs.mapInArrow(joined, "w binary, s binary") if last else docs.mapInArrow(filled, "lang string, text binary, ids binary")
            docs = self._kept(made, f"encoded-{i}")
        return docs

    def candidates(self, corpus: DataFrame, k: int) -> DataFrame:
        """Keys of phrases of k words that occur often enough."""
        # Beyond a byte's range counts are taken by the ratio, rounded up: some keys too many, never one too few.
        width, ratio = self.width, -(-self.min_count // 127)
        enough = -(-self.min_count // ratio)

        parts = max(1, -(-self.total // PART_KEYS))

        def some(batches):
            """Keys of a few rows at a time."""
            held, size = [], 0
            for batch in batches:
                for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.append(candidate_keys(w, s, k, width)[1])
                    size += len(held[-1])
                    if size >= HELD_KEYS:
                        yield np.concatenate(held)
                        held, size = [], 0
            if size:
                yield np.concatenate(held)

        def keys(batches):
            for found in some(batches):
                found, n = np.unique(found, return_counts=True)
                n = np.minimum(-(-n // ratio), enough).astype(np.uint8)
                part = (mix64(found) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                found, n, part = found[order], n[order], part[order]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b in zip(first.tolist(), np.append(first[1:], len(part)).tolist()):
                    yield _record(part=(int(part[a]), pa.int32()), keys=(found[a:b].tobytes(), pa.binary()), counts=(n[a:b].tobytes(), pa.binary()))

        def add(group):
            found = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in group.column("keys")])
            n = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in group.column("counts")])
            order = np.argsort(found, kind="stable")
            found, n = found[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.diff(found, prepend=-1))
            return pa.table({"key": pa.array(found[first][np.add.reduceat(n, first) >= enough])})

        sent = corpus.mapInArrow(keys, "part int, keys binary, counts binary")
        return sent.groupBy("part").applyInArrow(add, "key long")

    def stamp(self, corpus: DataFrame, k: int) -> DataFrame:
        """The corpus with the slots of phrases of k words in place of those of k - 1."""
        starts, width = self.starts[k], self.width
        made = corpus.withColumn("t", F.lit(None).cast("binary"))
        for i in range(len(starts) - 1):
            shared, base, last = self._table(str(k), i), starts[i], i == len(starts) - 2

            def look_up(batches):
                seen = shared.value
                for batch in batches:
                    for w, s, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                        at, keys = candidate_keys(w, s, k, width)
                        slots = np.full(len(w) // 8, -1, dtype=np.int64) if t is None else np.frombuffer(t, dtype=np.int64).copy()
                        if seen and len(keys):
                            found = seen.find(keys)
                            slots[at[found >= 0]] = found[found >= 0] + base
                        if last:
                            yield from _row(*_shortened(np.frombuffer(w, dtype=np.int64), slots, k))
                        else:
                            yield from _row(w, s, slots)

            made = self._kept(made.mapInArrow(look_up, "w binary, s binary" if last else "w binary, s binary, t binary"), f"stamped-{k}-{i}")
        return made

    def counts(self, corpus: DataFrame, k: int) -> DataFrame:
        """(slot, a): how often the phrases of k words occur."""

        def arrays(batches):
            held: dict[int, np.ndarray] = {}

            def sent():
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["cell", "counts"])
                held.clear()

            for batch in batches:
                for s in batch.column(0).to_pylist():
                    s = np.sort(np.frombuffer(s, dtype=np.int64))
                    s = s[np.searchsorted(s, 0) :]
                    first = np.flatnonzero(np.diff(s // CELL, prepend=-1))
                    for a, b in zip(first, np.append(first[1:], len(s))):
                        cell = int(s[a]) // CELL
                        if cell not in held and len(held) >= HELD_CELLS:
                            yield from sent()
                        held.setdefault(cell, np.zeros(CELL, dtype=np.int64))
                        held[cell] += np.bincount(s[a:b] % CELL, minlength=CELL)
            if held:
                yield from sent()

        def total(group):
            out = np.zeros(CELL, dtype=np.int64)
            for x in group.column("counts"):
                out += np.frombuffer(x.as_buffer(), dtype=np.int64)
            return out

        def add(key, group):
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total(group).tobytes()], pa.binary())})

        def last(key, group):
            n = total(group)
            at = np.flatnonzero(n)
            return pa.table({"slot": pa.array(at + key[0].as_py() * CELL), "a": pa.array(n[at])})

        made = corpus.select("s").mapInArrow(arrays, "cell long, counts binary").withColumn("task", F.spark_partition_id().cast("long"))
        # At most so many tasks have read the corpus; a cell has some arrays of each.
        tasks = corpus.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            made = made.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("cell", "task").applyInArrow(add, "cell long, task long, counts binary")
        return made.groupBy("cell").applyInArrow(last, "slot long, a long")

    def levels(self) -> tuple[DataFrame, dict[int, DataFrame]]:
        """(lang, n), and by length the frequent phrases with what their cuts need."""
        totals, found = self.words()
        words = self._kept(found.select("slot", "lang", F.col("word").alias("phrase"), F.col("n").alias("a")), "level-1")
        made, corpus = {1: words}, self.encode()
        for k in range(2, self.longest + 1):
            self.starts[k] = self._tables(self._kept(self.candidates(corpus, k), f"candidates-{k}"), str(k), lambda c: KeyTable(c[0].to_numpy()))
            corpus = self.stamp(corpus, k)
            keyed = self._slots(str(k), self.starts[k], lambda t: pa.array(t.stored), "long").join(self.counts(corpus, k).where(F.col("a") >= self.min_count), "slot")
            made[k] = self._kept(cuts(keyed, made, k, self.width), f"level-{k}")
        return totals, made


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _record(**fields) -> pa.RecordBatch:
    """One row, of (value, type) by name."""
    return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in fields.values()], names=list(fields))


def _row(*arrays):
    yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in arrays], names=list("wst")[: len(arrays)])


def candidate_keys(w: bytes, s: bytes, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the phrases of k words of which both parts of k - 1 words are frequent."""
    w, s = np.frombuffer(w, dtype=np.int64), np.frombuffer(s, dtype=np.int64)
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, s[at] * width + w[at + k - 1]


def _shortened(w: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that neither start a phrase of k words nor stand in a candidate for k + 1."""
    keep = s >= 0
    longer = np.flatnonzero(keep[:-1] & keep[1:])
    for j in range(k + 1):
        keep[longer + j] = True
    at = squeezed(keep) if len(keep) else np.arange(0)
    stays = keep[at]
    return np.where(stays, w[at], -1), np.where(stays, s[at], -1)


def cuts(keyed: DataFrame, made: dict[int, DataFrame], k: int, width: int) -> DataFrame:
    """The phrases of k words (slot, key, a) with language, text, parts and, in ``cuts``, (l, r) of the cuts after 1, 2, ... words.

    A phrase's first words are its prefix with the last word gone; its last words are found by the key they have.
    """
    parts = keyed.withColumn("prefix", F.expr(f"key div {width}L")).withColumn("last", F.expr(f"key % {width}L"))
    word = made[1].select(F.col("slot").alias("last"), F.col("phrase").alias("__word"), F.col("a").alias("__r"))
    below = made[k - 1]
    before = below.select(F.col("slot").alias("prefix"), "lang", F.col("phrase").alias("__head"), F.col("a").alias("__l"), *([F.col("suffix").alias("__suffix"), F.col("cuts").alias("__left")] if k > 2 else []))
    out = parts.join(word, "last").join(before, "prefix")
    pair = lambda left, right: F.struct(left.alias("l"), right.alias("r"))
    whole = pair(F.col("__l"), F.col("__r"))
    if k == 2:
        out = out.withColumn("suffix", F.col("last")).withColumn("cuts", F.array(whole))
    else:
        # The cut of the whole after j words: its left part is that of the prefix after j words, its right part that of the suffix after j - 1.
        after = below.select(F.col("slot").alias("suffix"), F.col("key").alias("__key"), F.col("a").alias("__tail"), F.col("cuts").alias("__right"))
        out = out.withColumn("__key", F.col("__suffix") * F.lit(width) + F.col("last")).join(after, "__key")
        first = F.array(pair(F.get("__left", F.lit(0)).l, F.col("__tail")))
        middle = F.transform(F.sequence(F.lit(1), F.lit(k - 2)), lambda j: pair(F.get("__left", j).l, F.get("__right", j - 1).r))
        middle = F.slice(middle, 1, k - 3)
        out = out.withColumn("cuts", F.concat(first, middle, F.array(whole)))
    return out.select("slot", "key", "a", "lang", F.concat_ws(" ", "__head", "__word").alias("phrase"), "prefix", "suffix", "cuts")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase has the score floor(SCALE a / (l + r)) of its lowest cut (of equal ones the first). Phrases inside a longer one
    that has ``covered`` per cent of their count or more are left out. Higher scores first, then counts, then by bytes.
    The passes over the corpus run while the result is built; the result reads the tables of levels.
    """
    corpus = Corpus(docs, lang_col, text_col, min_count, longest)
    with small_batches(corpus.spark):
        totals, made = corpus.levels()
    for name in {f"encoded-{i}" for i in range(len(corpus.starts[1]) - 1)} | {f"stamped-{k}-{i}" for k in range(2, longest + 1) for i in range(len(corpus.starts[k]) - 1)}:
        drop_folder(corpus.spark, f"{corpus.folder}/{name}")
    kept = []
    for k in range(2, longest + 1):
        level = made[k]
        if k < longest:
            # The largest count of a phrase around this one: one with one word more, as counts only fall.
            longer = made[k + 1]
            around = longer.select(F.col("prefix").alias("slot"), F.col("a").alias("__around")).unionByName(longer.select(F.col("suffix").alias("slot"), F.col("a").alias("__around")))
            level = level.join(around.groupBy("slot").agg(F.max("__around").alias("__around")), "slot", "left")
            level = level.where(F.coalesce(_exact("__around") * 100 < _exact("a") * covered, F.lit(True)))
        kept.append(level.select("lang", "phrase", "a", "cuts"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    scored = F.transform("cuts", lambda c, j: F.struct(_score(F.col("a"), c).alias("score"), j.alias("j"), c.l.alias("l"), c.r.alias("r")))
    rows = rows.select("lang", "phrase", "a", F.array_min(scored).alias("__cut")).select("lang", "phrase", "a", "__cut.l", "__cut.r", "__cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "__part").orderBy(*best)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN))).withColumn("__rank", F.row_number().over(some)).where(F.col("__rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def _score(a: Column, cut: Column) -> Column:
    """floor(SCALE a / (l + r)) in decimals, as the product may pass 64 bits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    both = cut.l.cast("decimal(20,0)") + cut.r.cast("decimal(20,0)")
    return F.call_function("div", product, both)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
