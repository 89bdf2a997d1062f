"""Ordered scans in which a row depends on earlier decisions, for keys of any size.

``in_chunks`` cuts the rows of a table, sorted by key and order, into ranges of some ROWS rows. A key with more rows than that
lies in several chunks, one after the other; a chunk is one group of one task, whatever the key. Only the first and the last
key of a range can go on beyond it, so all that passes between chunks is a few states for each range of the table, which the
driver may hold.

``scan`` runs any machine. All chunks run at once, from the machine's start; then those whose true entry, the exit of the chunk
before, differs from the one they ran with run again, until nothing changes. A machine that forgets (a quiet hour, a flush, a
reset) is done after two rounds; one that never forgets takes a round for each chunk of its longest key, and is right as well.

``chain`` marks what a walk from the first row of a key visits, where each row has one successor: the first row of its key whose
time is at or after a bound that grows with the row's own time. Here rounds are bounded: chunks work out where a walk that
enters at any of their rows leaves them, and pointer doubling over these exits needs log2 of the number of chunks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quern.sources.sinks import checkpointed

#: Rows of a chunk, about.
ROWS = 200_000
KEY, CHUNK, TIE = "__key", "__chunk", "__tie"


def in_chunks(df: DataFrame, key: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """``df`` with its key as a string (nulls are a key of their own), a number that settles ties of ``order``, and the chunk; kept, as ranges are drawn from a sample."""
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    marked = df.withColumns({KEY: name, TIE: F.xxhash64(*df.columns)})
    count = max(1, -(-df.count() // rows))
    return checkpointed(marked.repartitionByRange(count, KEY, *order, TIE).withColumn(CHUNK, F.spark_partition_id()))


def _links(rows: DataFrame) -> dict[tuple[str, int], int | None]:
    """For the chunks of keys with several: the chunk of the same key before."""
    found = rows.select(KEY, CHUNK).distinct()
    several = found.groupBy(KEY).agg(F.sort_array(F.collect_list(CHUNK)).alias("chunks")).where(F.size("chunks") > 1)
    # At most two keys of each range: the first and the last one.
    return {(r[KEY], c): before for r in several.collect() for before, c in zip([None, *r["chunks"]], r["chunks"])}


def scan(rows: DataFrame, order: list[str], run: Callable[[pd.DataFrame, str | None, bool], tuple[pd.DataFrame, str | None]], schema: str) -> DataFrame:
    """The output of ``run`` over the chunks of each key in order.

    run: from a chunk's sorted rows, the state left by the chunk before (None at a key's start; bounded text) and whether the
    key ends with this chunk, to output rows and the state at the chunk's end. The rounds run while the result is built.
    """
    spark, links = rows.sparkSession, _links(rows)
    by = [*order, TIE]

    def ordered(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(by, kind="stable").reset_index(drop=True)

    final = set(links) - {(k, before) for (k, _), before in links.items()}
    entry: dict[tuple[str, int], str | None] = dict.fromkeys(links)
    todo, leaves = list(links), {}
    while todo:
        given = dict(entry)

        def ends(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            key = (name[0], int(name[1]))
            return pd.DataFrame({KEY: [key[0]], CHUNK: [key[1]], "state": [run(ordered(frame), given[key], key in final)[1]]})

        wanted = F.broadcast(spark.createDataFrame(todo, f"{KEY} string, {CHUNK} int"))
        found = rows.join(wanted, [KEY, CHUNK], "left_semi").groupBy(KEY, CHUNK).applyInPandas(ends, f"{KEY} string, {CHUNK} int, state string")
        leaves.update(((r[KEY], r[CHUNK]), r["state"]) for r in found.collect())  # a row for each chunk that ran
        true = {(k, c): None if before is None else leaves[k, before] for (k, c), before in links.items()}
        todo = [x for x in links if true[x] != entry[x]]
        entry = true

    def out(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        key = (name[0], int(name[1]))
        return run(ordered(frame), entry.get(key), key in final or key not in links)[0]

    return rows.groupBy(KEY, CHUNK).applyInPandas(out, schema)


def exits(times: np.ndarray, gap: int) -> np.ndarray:
    """For a walk that stands on each row: the bound that the first row beyond the chunk must reach."""
    n = len(times)
    after = np.searchsorted(times, times + gap)
    here = np.where(after < n, after, np.arange(n))
    while True:  # pointer doubling within the chunk
        further = here[here]
        if (further == here).all():
            return times[here] + gap
        here = further


def chain(df: DataFrame, key: str, time: str, gap: int, rows: int = ROWS) -> DataFrame:
    """The rows that a walk visits which starts on a key's first row and goes on to the first row at least ``gap`` (over 0) after the one it stands on; of equal times the first by hash of the row."""
    spark, columns = df.sparkSession, df.columns
    timed = in_chunks(df.where(F.col(time).isNotNull()), key, [time], rows)
    links = _links(timed)
    entry: dict[tuple[str, int], int] = {}
    if links:
        split = timed.join(F.broadcast(spark.createDataFrame(list(links), f"{KEY} string, {CHUNK} int")), [KEY, CHUNK], "left_semi").select(KEY, CHUNK, time)
        held: dict[str, list[tuple[int, int]]] = {}
        for r in split.groupBy(KEY, CHUNK).agg(F.max(time).alias("last")).collect():
            held.setdefault(r[KEY], []).append((r[CHUNK], r["last"]))
        chunks = {k: [c for c, _ in sorted(v)] for k, v in held.items()}
        lasts = {k: [t for _, t in sorted(v)] for k, v in held.items()}

        def target(k: str, bound: int) -> int:
            """The chunk of a key that holds the first row at or after ``bound``, -1 if none does."""
            at = bisect_left(lasts[k], bound)
            return chunks[k][at] if at < len(chunks[k]) else -1

        def leave(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            k, c = name[0], int(name[1])
            bounds = np.unique(exits(np.sort(frame[time].to_numpy()), gap))
            return pd.DataFrame({KEY: [k] * len(bounds), CHUNK: c, "bound": bounds, "to": [target(k, int(b)) for b in bounds]})

        # A node is a bound with which a walk enters chunk ``to``.
        nodes = checkpointed(split.groupBy(KEY, CHUNK).applyInPandas(leave, f"{KEY} string, {CHUNK} int, bound long, to int").where("to >= 0").select(KEY, F.col("to").alias(CHUNK), "bound").distinct())

        def follow(name: tuple, here: pd.DataFrame, entering: pd.DataFrame) -> pd.DataFrame:
            if not len(entering) or not len(here):
                return pd.DataFrame({c: [] for c in (KEY, CHUNK, "bound", "to", "next")}, dtype=object)
            k, c = name[0], int(name[1])
            times = np.sort(here[time].to_numpy())
            next_ = exits(times, gap)[np.searchsorted(times, entering["bound"].to_numpy())]
            return pd.DataFrame({KEY: [k] * len(next_), CHUNK: c, "bound": entering["bound"].to_numpy(), "to": [target(k, int(b)) for b in next_], "next": next_})

        edge = f"{KEY} string, {CHUNK} int, bound long, to int, next long"
        jumps = checkpointed(split.groupBy(KEY, CHUNK).cogroup(nodes.groupBy(KEY, CHUNK)).applyInPandas(follow, edge).where("to >= 0"))
        # The first chunk of a key is entered at its first row, below any bound.
        first = {k: c[0] for k, c in chunks.items()}
        roots = split.join(F.broadcast(spark.createDataFrame(list(first.items()), f"{KEY} string, {CHUNK} int")), [KEY, CHUNK], "left_semi")
        start = roots.groupBy(KEY, CHUNK).applyInPandas(lambda name, frame: leave_first(name, frame, time, gap, target), f"{KEY} string, {CHUNK} int, bound long")
        reached = checkpointed(start.where(f"{CHUNK} >= 0"))
        for _ in range(max(1, max(map(len, chunks.values())).bit_length())):
            step = reached.join(jumps, [KEY, CHUNK, "bound"]).select(KEY, F.col("to").alias(CHUNK), F.col("next").alias("bound"))
            reached = checkpointed(reached.union(step).distinct())
            twice = jumps.select(KEY, F.col(CHUNK).alias("a"), F.col("bound").alias("x"), F.col("to").alias(CHUNK), F.col("next").alias("bound"))
            jumps = checkpointed(twice.join(jumps, [KEY, CHUNK, "bound"]).select(KEY, F.col("a").alias(CHUNK), F.col("x").alias("bound"), "to", "next"))
        # A walk enters a chunk once, so there is one bound for each at most.
        entry = {(r[KEY], r[CHUNK]): r["bound"] for r in reached.collect()}
        entry |= dict.fromkeys(first.items())

    def mark(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([time, TIE], kind="stable")
        times, where = frame[time].to_numpy(), (name[0], int(name[1]))
        bound = entry.get(where) if where in entry or where not in links else np.iinfo(np.int64).max
        at, kept = 0 if bound is None else int(np.searchsorted(times, bound)), []
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + gap))
        # Objects, as an empty selection of a string column is no Arrow array of one piece.
        return frame.iloc[kept][columns] if kept else frame[columns].iloc[:0].astype(object)

    return timed.groupBy(KEY, CHUNK).applyInPandas(mark, df.schema)


def leave_first(name: tuple, frame: pd.DataFrame, time: str, gap: int, target) -> pd.DataFrame:
    bound = int(exits(np.sort(frame[time].to_numpy()), gap)[0])
    return pd.DataFrame({KEY: [name[0]], CHUNK: [target(name[0], bound)], "bound": [bound]})


def running_max(rows: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` of ``in_chunks`` with, for each name, the maximum of a column over all rows of the key before (null at the start): within chunks by windows, and over the chunks before."""
    tops = rows.groupBy(KEY, CHUNK).agg(*[F.max(c).alias(f"__{n}") for n, c in values.items()])
    earlier = W.partitionBy(KEY).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)  # a row for each chunk of a key
    before = tops.select(KEY, CHUNK, *[F.max(f"__{n}").over(earlier).alias(f"__{n}") for n in values])
    here = W.partitionBy(KEY, CHUNK).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns({n: F.max(c).over(here) for n, c in values.items()})
    return local.join(before, [KEY, CHUNK]).withColumns({n: F.greatest(n, f"__{n}") for n in values}).drop(*[f"__{n}" for n in values])
