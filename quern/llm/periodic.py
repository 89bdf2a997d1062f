"""Runs of consecutive words with a period, by masking what cannot repeat and Main-Lorentz on what is left.

A run of period q and length L >= max(6, 4q) overlaps its own shift by q in L - q words: 5 for q = 1, 6 for q = 2 and 3q above.
So every word of a run lies in a stretch of OVERLAP = 5 words that occurs twice in its document, and words outside such
repeated 5-grams can join no run. Each task hashes the 5-grams of a few documents at a time in numpy (equal hashes of unlike
5-grams only keep words that could have gone), and the divide-and-conquer search of Main and Lorentz with Z-functions looks
at the surviving segments alone, where it finds every run exactly in O(n log n). No data is shuffled; memory is bounded by a
batch of texts, or by one text where that is longer.

Defined results
* null and empty texts, texts of white space: no words, no runs, an empty collapsed text.
* ties: of equal exponents the smallest start is best, then the smallest period.
* repeated rows and extra columns: columns are added to whatever rows come in; an input column called like one of the added
  ones is replaced.
* very long texts: taken whole, in a chunk of their own.
* empty tables: empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.shared import table

#: Least length of a run, and least length in periods.
LEAST, TIMES = 6, 4
#: Least overlap of a run with its shift: min over q of max(LEAST, TIMES q) - q.
OVERLAP = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST))
#: Words of whole texts that are searched for repeated 5-grams at once.
CHUNK_WORDS = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WHITE = r"[ \t-\r]+"

FOUND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: binary, words: bigint, best: int>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated(words: np.ndarray, starts: np.ndarray, k: int = OVERLAP) -> list[tuple[int, int]]:
    """The stretches [from, to) of ``words`` that repeated k-grams of one document cover; ``starts``: where documents start, and the end.

    A stretch lies in one document. All words of runs that overlap their shift by k or more words are in a stretch.
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words) - k + 1
    if n < 2:
        return []
    whole = doc[:n] == doc[k - 1 :]
    with np.errstate(over="ignore"):
        h = (doc[:n].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        for j in range(k):
            h = (h ^ (h >> np.uint64(29))) * MULTIPLIER + words[j : j + n].astype(np.uint64)
        h *= MULTIPLIER
    at = np.flatnonzero(whole)
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at[1:]] == h[at[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = np.sort(at[twice])
    if not len(at):
        return []
    # Stretches end where the next k-gram starts after this one's end, or in another document.
    last = np.append(np.flatnonzero((np.diff(at) > k) | (doc[at[1:]] != doc[at[:-1]])), len(at) - 1)
    first = np.append(0, last[:-1] + 1)
    return [(a, b) for a, b in zip(at[first].tolist(), (at[last] + k).tolist()) if b - a >= LEAST]


def matches(pattern: list, text: list, count: int) -> list[int]:
    """For each of the first ``count`` places of ``text`` after the first: how many words from there on equal the start of ``pattern``.

    ``text`` starts with ``pattern``, or is equal to it, so that place 0 needs no search (a Z-function).
    """
    n, limit = len(text), len(pattern)
    z = [0] * (count + 1)
    left = right = 0
    for i in range(1, count + 1):
        k = 0
        if i < right:
            k = z[i - left]
            if k >= right - i:
                k = right - i
        while i + k < n and k < limit and pattern[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(x: list, middle: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of maximal stretches of ``x`` whose words at middle - 1 and at middle - 1 + period are equal, periods 1 to ``most``."""
    forth = matches(x[middle:], x[middle:], most)
    # Read backwards from the middle: x[middle-1], x[middle-2], ... against x[middle+p-1], x[middle+p-2], ...
    back = x[middle - 1 :: -1] if middle else []
    ahead = x[middle + most - 1 :: -1]
    behind = place_matches(back, ahead, most)
    for p in range(1, most + 1):
        if behind[p] and behind[p] + forth[p] >= p:
            yield middle - behind[p], middle + p + forth[p], p


def place_matches(pattern: list, text: list, most: int) -> list[int]:
    """result[p], p = 1..most: how many words of ``text`` from place most - p on equal the start of ``pattern``."""
    own = matches(pattern, pattern, len(pattern) - 1) if pattern else []
    if own:
        own[0] = len(pattern)
    n, limit, out = len(text), len(pattern), [0] * (most + 1)
    left = right = 0
    for i in range(most):
        k = 0
        if i < right:
            k = min(own[i - left], right - i)
        while k < limit and i + k < n and pattern[k] == text[i + k]:
            k += 1
        out[most - i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def runs_of(x: list) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of ``x``, by start and period (Main and Lorentz, divide and conquer)."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        size = high - low
        if size < LEAST:
            continue
        middle = (low + high) // 2
        todo += [(low, middle), (middle, high)]
        part, m, most = x[low:high], middle - low, size // TIMES
        mirror = part[::-1]
        # A run that reaches a period or more beyond the middle is met from the left, any other from the right.
        right = ((a, b, p) for a, b, p in crossing(part, m, most)) if part[m - 1] in part[m : m + most] else ()
        left = ((size - b, size - a, p) for a, b, p in crossing(mirror, size - m, most)) if part[m] in part[m - most : m] else ()
        for side in (right, left):
            for a, b, p in side:
                if b - a < LEAST or b - a < TIMES * p:
                    continue
                a, b = a + low, b + low
                # What could go on beyond this part is found whole in a larger one.
                if a == low and low and x[low - 1] == x[low - 1 + p] or b == high and high < len(x) and x[high] == x[high - p]:
                    continue
                if found.get((a, b), p) >= p:
                    found[a, b] = p
    return sorted((a, b - a, p) for (a, b), p in found.items())


def search(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes, int]]:
    """Runs, collapsed text and number of words of each text, in order."""
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.split() if text else []
        if group and size + len(words) > CHUNK_WORDS:
            yield from _chunk(group)
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield from _chunk(group)


def _chunk(group: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes, int]]:
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    starts = np.cumsum([0, *map(len, group)])
    words = np.fromiter((i for doc in group for i in map(ids.__getitem__, doc)), dtype=np.int64, count=int(starts[-1]))
    ids.clear()
    runs: list[list[tuple[int, int, int]]] = [[] for _ in group]
    spans = repeated(words, starts)
    owners = np.searchsorted(starts, [a for a, _ in spans], side="right") - 1
    for (a, b), owner in zip(spans, owners.tolist()):
        base = a - int(starts[owner])
        runs[owner] += [(base + s, length, p) for s, length, p in runs_of(words[a:b].tolist())]
    for doc, found in zip(group, runs):
        kept = doc
        if found:
            stays = np.ones(len(doc), dtype=bool)
            for s, length, p in found:
                stays[s + p : s + length] = False
            kept = [doc[i] for i in np.flatnonzero(stays).tolist()]
        yield found, b" ".join(kept), len(doc)


def _best(found: list[tuple[int, int, int]]) -> int | None:
    best = None
    for i, (_, length, period) in enumerate(found):  # in order of start and period: the first of equals stays
        if best is None or length * found[best][2] > found[best][1] * period:
            best = i
    return best


def runs_column(text: Column) -> Column:
    """Struct of runs (by start, then period), collapsed text (binary), number of words and the index of the run of the greatest exponent."""

    @F.arrow_udf(FOUND)
    def run(batch: pa.Array) -> pa.Array:
        found, collapsed, words, best = [], [], [], []
        for runs, text, n in search(batch.to_pylist()):
            found.append(runs)
            collapsed.append(text)
            words.append(n)
            best.append(_best(runs))
        flat = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
        offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        structs = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(_RUN))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()), pa.array(words, pa.int64()), pa.array(best, pa.int32())],
            names=["runs", "collapsed", "words", "best"],
        )

    return run(text.cast("binary"))


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with runs (array of start, length, period), collapsed (the text without repetitions, words joined by a space), words and best (a run, or null)."""
    added = ("runs", "collapsed", "words", "best")
    name = "__found"
    while name in docs.columns:
        name += "_"
    made = docs.withColumn(name, runs_column(docs[text_col]))
    found = F.col(name)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return made.select(
        *kept,
        found.runs.alias("runs"),
        found.collapsed.cast("string").alias("collapsed"),
        found.words.alias("words"),
        F.when(found.best.isNotNull(), F.get(found.runs, found.best)).alias("best"),
    )


def planted(text: Column, doc_id: Column) -> Column:
    """The text, in which a tenth of all ids gets a periodic end: words from a on are repetitions of p words. Rows without id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        end = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), end), " ")).otherwise("")

    # The split text as a lambda's argument is made once.
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(F.transform(F.array(words), changed), F.lit(0))).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.col("best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic": op13_periodic}
