"""Byte-level BPE by merge replay over the vocabulary of a corpus slice.

Each task walks its share of the corpus in chunks. The distinct words (matches of the pre-tokenizer pattern) of a chunk
that were not met before are laid out in one array of byte symbols; an inverted index maps every rank to the positions of
the pairs that merge into it; ranks are replayed in order, and a merge touches only the two neighbours of its position.
The encoded words are kept in a bounded table, so a word costs its merges once per table, and texts are then assembled by
lookup. Nothing is shuffled and no vocabulary leaves its task, so the work is linear in the input.

Defined results
* null and empty texts: no ids, empty bytes.
* very long texts: taken in pieces of CHUNK_WORDS units, so memory does not grow with one text beyond its output.
* ids outside the vocabulary when decoding: they contribute no bytes.
* repeated rows and extra columns: ``encode`` and ``decode`` add columns to whatever rows come in (replacing columns of
  the same names); empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Units (a run of non-spaces with the space before it) taken at once from a long text.
CHUNK_WORDS = 500_000
#: Positions of a rank from which a merge is done on all of them at once.
MANY = 24
#: Keys of a generation of a table of encoded strings (some 16 MB).
MAX_KEYS = 80_000
#: Texts whose ids are held at once when only their digests are wanted.
DIGESTED = 1000
#: Marks the first piece of a text: a character that no valid text holds.
FIRST = "\udcff"
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
#: Unicode White_Space, inside a character class (fixed values).
SPACES = "\t-\r \x85\xa0  -     　"


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _class_of(*initials: str) -> str:
    """The characters whose general category starts with one of ``initials``, as the inside of a character class."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in initials:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """(units, words): the pre-tokenizer pattern in two steps, in the standard library's syntax.

    A unit is a run of non-spaces with at most one space before it, or white space. No match of the pre-tokenizer
    pattern crosses the border of a unit or depends on what lies beyond it, so units can be split on their own.
    """
    letters, numbers = _class_of("L"), _class_of("N")
    units = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
    words = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )
    return units, words


class Table:
    """Encoded strings, at most two generations of MAX_KEYS and one chunk: what a full generation's successor meets again is carried over, the rest is forgotten."""

    def __init__(self):
        self.now: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def missing(self, found) -> set[str]:
        """The keys of ``found`` that must be encoded; all others are in ``now`` afterwards."""
        if len(self.now) > MAX_KEYS:
            self.now, self.old = {}, self.now
        new = set(found).difference(self.now)
        if self.old:
            again = new & self.old.keys()
            self.now.update((k, self.old[k]) for k in again)
            new -= again
        return new


def piece_words(piece: str) -> list[str] | None:
    """The words of what stands between two spaces: a space (none at the start of a text or before a line end) and the piece. None where white space touches the piece's ends, so that its words depend on its neighbours."""
    if piece.isalpha():
        return [" " + piece]
    if piece[:-1].isalpha() and piece[-1] in ".,;:!?|":
        return [" " + piece[:-1], piece[-1]]
    head = piece[:1] if piece[:1] in (FIRST, "\n") else ""
    rest = piece[len(head) :]
    if not rest or rest != rest.strip(WHITE):
        return None
    if head == FIRST:
        return patterns()[1].findall(rest)
    return patterns()[1].findall((head or " ") + rest)


class Codec:
    """Encoder and decoder for one rank file; ``ranks`` maps byte strings to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: No symbol: it stands between words.
        self.border = max(ranks.values()) + 1
        self.shift = self.border.bit_length()
        #: What two neighbouring symbols merge into: the id of their joined bytes, whichever way they were cut.
        self.merged = {
            ranks[b[:k]] << self.shift | ranks[b[k:]]: i
            for b, i in ranks.items()
            for k in range(1, len(b))
            if b[:k] in ranks and b[k:] in ranks
        }
        self.pairs = np.full(65536, -1, dtype=np.int64)
        for b, i in ranks.items():
            if len(b) == 2:
                self.pairs[b[0] * 256 + b[1]] = i
        self.table: list[bytes | None] = [self.bytes_of.get(i) for i in range(self.border)]
        self.pieces, self.units, self.words = Table(), Table(), Table()

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        # The words one after the other, with a border before each and one at the end.
        starts = np.cumsum(lengths + 1) - lengths
        total = int(lengths.sum()) + len(words) + 1
        place = np.ones(total, dtype=bool)
        place[0] = False
        place[starts - 1] = False
        place[total - 1] = False
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        symbols = np.full(total, self.border, dtype=np.int64)
        symbols[place] = self.single[flat]
        raw = np.zeros(total, dtype=np.int64)
        raw[place] = flat
        code = np.full(total, -1, dtype=np.int64)
        both = np.flatnonzero(place[:-1] & place[1:])
        code[both] = self.pairs[raw[both] * 256 + raw[both + 1]]
        # The inverted index: rank -> positions of the left symbols of the pairs that merge into it.
        order = both[np.argsort(code[both], kind="stable")]
        order = order[np.searchsorted(code[order], 0) :]
        index: dict[int, list[int]] = {}
        if len(order):
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            index = {int(code[p[0]]): p.tolist() for p in np.split(order, cuts[1:])}
        # Arrays for steps over many positions, and views of the same memory for steps over few.
        at_all, symbol_all = code, symbols  # at: the rank of the pair that starts here; -1: none
        after_all, before_all = np.arange(1, total + 1), np.arange(-1, total - 1)
        at, symbol, after, before = (memoryview(x) for x in (at_all, symbol_all, after_all, before_all))
        merged, posted, push, pop, shift = self.merged.get, index.get, heapq.heappush, heapq.heappop, self.shift
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = pop(heap)
            todo = index.pop(rank, None)
            if todo is None:
                continue
            high = rank << shift
            if len(todo) >= MANY:
                here = np.sort(np.array(todo))
                here = here[np.diff(here, prepend=-1) > 0]
                here = here[at_all[here] == rank]
                gone = after_all[here]
                right, left = after_all[gone], before_all[here]
                # Neighbours as they will be: one that merges in this step, too, is the new symbol.
                beyond = np.where(at_all[right] == rank, rank, symbol_all[right])
                outer = before_all[left]
                joins = (outer >= 0) & (at_all[outer] == rank)
                ahead = np.where(joins, rank, symbol_all[left])
                new_right = list(map(merged, (high | beyond).tolist(), repeat(-1)))
                new_left = list(map(merged, ((ahead << shift) | rank).tolist(), repeat(-1)))
                low = [r for r in new_right if 0 <= r < rank] or [r for r in new_left if 0 <= r < rank]
                # Pairs that overlap, or a lower rank that comes up, need the order of positions.
                if not low and not (at_all[gone] == rank).any():
                    after_all[here] = right
                    before_all[right] = here
                    symbol_all[here] = rank
                    at_all[gone] = -1
                    symbol_all[gone] = -1
                    left = np.where(joins, outer, left)
                    at_all[left] = new_left
                    at_all[here] = new_right
                    found, places = np.array(new_right + new_left), np.concatenate([here, left])
                    order = np.argsort(found, kind="stable")
                    order = order[np.searchsorted(found[order], 0) :]
                    found, places = found[order], places[order].tolist()
                    cuts = [*np.flatnonzero(np.diff(found, prepend=-1)).tolist(), len(found)]
                    for r, start, stop in zip(found[cuts[:-1]].tolist(), cuts, cuts[1:]):
                        if (posts := posted(r)) is None:
                            index[r] = places[start:stop]
                            push(heap, r)
                        else:
                            posts.extend(places[start:stop])
                    continue
            todo.sort()
            for k, i in enumerate(todo):
                if at[i] != rank:
                    continue
                gone = after[i]
                after[i] = right = after[gone]
                before[right] = i
                symbol[i] = rank
                at[gone] = -1
                symbol[gone] = -1
                low = rank
                at[i] = r = merged(high | symbol[right], -1)
                if r >= 0:
                    if (posts := posted(r)) is None:
                        index[r] = [i]
                        push(heap, r)
                    else:
                        posts.append(i)
                    if r < low:
                        low = r
                left = before[i]
                at[left] = r = merged(symbol[left] << shift | rank, -1)
                if r >= 0:
                    if (posts := posted(r)) is None:
                        index[r] = [left]
                        push(heap, r)
                    else:
                        posts.append(left)
                    if r < low:
                        low = r
                if low < rank:  # a lower rank came up: it goes first, then the rest of this one
                    index.setdefault(rank, []).extend(todo[k + 1 :])
                    push(heap, rank)
                    break
        ids = symbol_all
        keep = np.flatnonzero((ids >= 0) & place)
        where = np.searchsorted(keep, starts)
        data = ids[keep].astype("<u4").tobytes()
        stop = np.append(where[1:], len(keep))
        return [data[4 * a : 4 * b] for a, b in zip(where.tolist(), stop.tolist())]

    def learn(self, table: "Table", found, split) -> None:
        """Encode the keys of ``found`` that ``table`` lacks. split: the words of a key, or None if it has no meaning of its own."""
        parts = {key: split(key) for key in table.missing(found)}
        if not parts:
            return
        known = self.words
        new = list(known.missing(chain.from_iterable(p for p in parts.values() if p)))
        known.now.update(zip(new, self.replay([w.encode() for w in new])))
        get = known.now.__getitem__
        table.now.update((key, None if p is None else get(p[0]) if len(p) == 1 else b"".join(map(get, p))) for key, p in parts.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        whole: list[str] = []
        size = 0
        find, split = patterns()[0], patterns()[1].findall

        def by_units(text: str) -> bytes:
            """For texts whose white space doesn't stand alone, and very long ones."""
            done, run = [], find.finditer(text)
            while units := [m[0] for m in islice(run, CHUNK_WORDS)]:
                self.learn(self.units, units, split)
                done.append(b"".join(map(self.units.now.__getitem__, units)))
            return b"".join(done)

        def flush() -> None:
            nonlocal group, whole, size
            self.learn(self.pieces, chain.from_iterable(group), piece_words)
            get = self.pieces.now.__getitem__
            for text, pieces in zip(whole, group):
                try:
                    out.append(b"".join(map(get, pieces)))
                except TypeError:  # a piece is None
                    out.append(by_units(text))
            group, whole, size = [], [], 0

        for text in texts:
            text = text or ""
            if len(text) > 8 * CHUNK_WORDS:
                flush()
                out.append(by_units(text))
                continue
            # The mark tells the first piece, which has no space before it, from the same piece further on.
            pieces = f"{FIRST}{text}".replace("\n", " \n").split(" ") if text else []
            group.append(pieces)
            whole.append(text)
            size += len(pieces)
            if size >= CHUNK_WORDS:
                flush()
        flush()
        return out

    def decode(self, ids: bytes | None) -> bytes:
        found = np.frombuffer(ids or b"", dtype="<u4").tolist()
        try:
            return b"".join(map(self.table.__getitem__, found))
        except (IndexError, TypeError):
            return b"".join([self.bytes_of.get(i, b"") for i in found])


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    """The codec of a rank file, loaded once per Python worker."""
    with open(path or default_ranks_path(), "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_column(text: Column, ranks_path: str | None = None) -> Column:
    """Binary column: the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(codec(ranks_path).encode(batch.tolist()), dtype=object)

    return run(text)


def decode_column(ids: Column, ranks_path: str | None = None) -> Column:
    @F.pandas_udf("binary")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([codec(ranks_path).decode(x) for x in batch.tolist()], dtype=object)

    return run(ids)


def round_trip_column(text: Column, ranks_path: str | None = None) -> Column:
    """Struct of token_ids and decoded, both from one pass: as two columns the ids would be made twice."""

    @F.pandas_udf("token_ids binary, decoded binary")
    def run(batch: pd.Series) -> pd.DataFrame:
        made = codec(ranks_path)
        ids = made.encode(batch.tolist())
        return pd.DataFrame({"token_ids": ids, "decoded": [made.decode(x) for x in ids]})

    return run(text)


def encode(docs: DataFrame, text_col: str = "text", into: str = "token_ids", ranks_path: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text_col`` as packed unsigned 32-bit integers. ``ranks_path``: the rank file on every worker; by default the installed public one."""
    return docs.withColumn(into, encode_column(F.col(text_col), ranks_path))


def decode(encoded: DataFrame, ids_col: str = "token_ids", into: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes that the packed ids stand for."""
    return encoded.withColumn(into, decode_column(F.col(ids_col), ranks_path))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)


def digest_column(text: Column, ranks_path: str | None = None) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256. Ids and decoded bytes are given up after each few texts, so that a worker never holds those of a whole batch."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batch: pd.Series) -> pd.DataFrame:
        made, texts, rows = codec(ranks_path), batch.tolist(), []
        for at in range(0, len(texts), DIGESTED):
            for ids in made.encode(texts[at : at + DIGESTED]):
                rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(made.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest_column(F.col("text")).alias("__made")).select("doc_id", "__made.*")


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
