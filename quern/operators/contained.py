"""Texts that are part of one another, found without comparing all with all, and the greedy filter built on that.

Of each text some of its grams are marks: in every window of w neighbouring grams the one of the least hash. A text within
another shares all its windows with it, and so all its marks; it is looked for under the rarest of them only. w and the gram grow
with the text (GRAMS), since short grams are frequent in many texts; the containing side is marked for each w that some text
uses; texts shorter than a gram are looked for as they are. What is found is verified, so hashes decide nothing.

All joins shuffle: Spark's guess at the size of a checkpoint comes from the files that were read, and many marks of each text
would be broadcast by it, through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.sources.sinks import checkpointed

#: Numbers of neighbouring grams of which one is a mark, and the characters of a gram, for texts of ever greater length.
GRAMS = {1: 8, 4: 8, 16: 16, 64: 32}
_MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring code points."""
    n = len(codes) - size + 1
    h = np.full(max(n, 0), size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size if n > 0 else 0):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIER) + codes[j : j + n].astype(np.uint64)
        return (h ^ (h >> np.uint64(29))) * np.uint64(_MULTIPLIER)


def doubled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each gram of twice the ``size``, by the hashes ``h`` of its halves."""
    with np.errstate(over="ignore"):
        h = (h[:-size] ^ (h[:-size] >> np.uint64(31))) * np.uint64(_MULTIPLIER) + h[size:]
        return (h ^ (h >> np.uint64(29))) * np.uint64(_MULTIPLIER)


def level(length: int) -> int:
    """The window of a text of ``length``; for texts shorter than a gram, minus their length."""
    return max((w for w, gram in GRAMS.items() if w + gram - 1 <= length), default=-length)


def marks(text: str, levels: list[int]) -> dict[int, np.ndarray]:
    """The marks of a text for each of the levels."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size, grams, out = 8, gram_hashes(codes, 8), {}
    for w in sorted(levels):
        while w > 0 and size < GRAMS[w]:
            grams, size = doubled(grams, size), 2 * size
        if w < 0:
            found = gram_hashes(codes, -w)
        elif len(grams) < w:
            continue
        else:
            seen = np.lib.stride_tricks.sliding_window_view(grams, w)
            found = grams[np.unique(seen.argmin(axis=1) + np.arange(len(seen)))]
        with np.errstate(over="ignore"):
            out[w] = np.unique(found + np.uint64(w % 1000) * np.uint64(_MULTIPLIER)).view(np.int64)
    return out


def met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides."""
    return left.join(right.hint("merge"), on, how)


def contained_pairs(texts: DataFrame) -> DataFrame:
    """(small, large) keys of ``texts`` (key, text; texts distinct, none empty) where one text is part of another."""
    n = F.length("text")
    of_length = F.coalesce(*[F.when(n >= w + GRAMS[w] - 1, w) for w in reversed(GRAMS)], -n)
    used = sorted(r[0] for r in texts.select(of_length.alias("w")).distinct().collect())  # a dozen

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                names, found, own = [], [np.zeros(0, dtype=np.int64)], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for w, x in marks(text, used).items():
                        names += [key] * len(x)
                        own += [w == level(len(text))] * len(x)
                        found.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(found)), pa.array(own, pa.bool_())], names=["key", "mark", "own"])

    rows = checkpointed(texts.select("key", "text").mapInArrow(run, "key string, mark long, own boolean"))
    counts = rows.groupBy("mark").agg(F.count("*").alias("n"))
    rarest = met(rows.where("own"), counts, "mark").groupBy("key").agg(F.min_by("mark", F.struct("n", "mark")).alias("mark"))
    near = met(rarest.select(F.col("key").alias("small"), "mark"), rows.select(F.col("key").alias("large"), "mark"), "mark").where("small <> large")
    of = lambda name: texts.select(F.col("key").alias(name), F.col("text").alias(f"__{name}"))
    pairs = met(met(near.select("small", "large"), of("small"), "small"), of("large"), "large")
    return pairs.where(F.contains("__large", "__small")).select("small", "large")


def not_contained(new: DataFrame, known: DataFrame, text: str, position: str = "position") -> DataFrame:
    """Rows of ``new`` whose text is no part of a known text and has none as a part. New rows go by ``position`` (unique); a row that stays is known from then on. Empty and null texts go.

    Equal to the loop over rows, but in rounds: a row stays when no row before it that is still undecided is near. The rounds
    run while the result is built.
    """
    key = F.sha2(F.col(text), 256)
    rows = checkpointed(new.where(F.length(text) > 0).groupBy(key.alias("key")).agg(F.min(position).alias("n"), F.first(text).alias("text")))
    old = known.where(F.length(text) > 0).select(key.alias("key"), F.col(text).alias("text")).distinct()
    texts = checkpointed(rows.select("key", "text").union(old).distinct())
    pairs = contained_pairs(texts)
    near = checkpointed(pairs.union(pairs.select("large", "small")).toDF("key", "other").distinct())
    held = old.select("key").union(met(near, old.select(F.col("key").alias("other")), "other").select("key")).distinct()
    left, kept = checkpointed(met(rows, held, "key", "left_anti").select("key", "n")), None
    while not left.isEmpty():
        first = met(near, left.select(F.col("key").alias("other"), F.col("n").alias("__n")), "other").groupBy("key").agg(F.min("__n").alias("__first"))
        now = checkpointed(met(left, first, "key", "left").where(F.coalesce(F.col("n") < F.col("__first"), F.lit(True))).select("key", "n"))
        kept = now if kept is None else kept.union(now)
        gone = now.select("key").union(met(near, now.select(F.col("key").alias("other")), "other").select("key")).distinct()
        left = checkpointed(met(left, gone, "key", "left_anti"))
    kept = left if kept is None else kept
    return met(new, kept.select(F.col("n").alias(position)), position, "left_semi").select(*new.columns)
