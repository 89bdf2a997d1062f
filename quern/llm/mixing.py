"""Mixing sources to target weights by fitting each source's budget as a bounded subset sum.

1. Documents are counted by (source, exact size); everything later works on these counts until the last step.
2. Targets: sources in code-point order take the weights in turn and share the whole; a target stops at ``cap`` times its
   source's size and the excess is shared again by weight until none is above.
3. Budget of a source: as many full passes over all its documents as fit, then a remaining budget below one pass. Of each
   size the proportional share is taken (rounded down), the rest of the budget is filled greedily from the largest size
   down to a window of WINDOW times the largest size left, and bounded-knapsack dynamic programming over the sizes still
   available fits the window: it finds the reachable sum nearest to the budget, be it below or above. A budget that the
   window holds from the start is fitted by the program alone. Where single documents can't come near a budget (a source of
   one large and few small ones), documents are repeated up to the cap, if that comes nearer.
4. Selection: of the documents of one (source, size) the wanted number is taken in the order of a seeded hash of the id.
   Groups are cut into ranges of that hash of some RANGE rows; whole ranges are taken or left by count, and only the rows of
   the range in which the number runs out are ranked. So no task sees more of a group than a range. Groups that hold more
   than a HOT-th of all documents (fewer than HOT of them, so their facts can be broadcast) are never shuffled by their key.

Defined results
* size: runs of characters other than ASCII white space; null and empty texts have size 0 and are never taken.
* a null source is one source, after all others; an empty source name is a source like any other.
* ties in the hash go by id, then rows alike count as any of each other. Repeated rows are documents of their own.
* all sizes zero: targets zero, nothing taken. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quern.llm.shared import cut

#: Weights of the sources in order, repeating; the cap on repeats; the seed (fixed values of the registered query).
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 42
#: The dynamic program covers budgets up to so many times the largest size that may still be taken.
WINDOW = 4
#: Documents are repeated before all are taken only where a budget would else be missed by more than this part of the target.
REPEAT = 1_000
#: Rows of a (source, size) that are ranked together, about.
RANGE = 1_000
#: A (source, size) with more than this part of all documents is hot.
HOT = 1_000
#: ASCII white space (fixed values).
WHITE = " \t\n\x0b\f\r"


def size_of(text: Column) -> Column:
    """Words of a text: each is put down to one letter and white space is taken out, which needs no list of the words."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x"), WHITE, "")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def share(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Targets by weight, none above ``cap`` times its size, that sum to all sizes."""
    total, target = float(sizes.sum()), np.zeros(len(sizes))
    limit, open_ = cap * sizes.astype(float), np.ones(len(sizes), dtype=bool)
    while open_.any():
        rest = total - target[~open_].sum()
        target[open_] = rest * weights[open_] / weights[open_].sum()
        above = open_ & (target > limit)
        if not above.any():
            break
        target[above] = limit[above]
        open_ &= ~above
    return target


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many of each size (positive, distinct) to take, at most ``counts``, so that they sum to nearly ``budget``; a budget within the window gets the nearest of all sums."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or not whole:
        return taken
    if budget >= whole:
        return counts.copy()
    # The proportional share keeps each source's mix of sizes; the program alone settles a budget that it can hold as a whole.
    # (Integers of any length: counts times budget may be large.)
    if budget > window * int(sizes.max()):
        taken = np.array([int(c) * budget // whole for c in counts.tolist()], dtype=np.int64)
    left = counts - taken
    rest = budget - int((sizes * taken).sum())
    order = np.argsort(-sizes, kind="stable")
    for k in order.tolist():
        size = int(sizes[k])
        if rest <= (window + 1) * size:
            break  # the window holds it; smaller sizes stay for the program
        n = min(int(left[k]), rest // size - window)
        taken[k] += n
        left[k] -= n
        rest -= n * size
    # Bounded knapsack: which sums up to the window can be reached, as bits; the first item that reaches each.
    # The least sum above the budget exceeds it by less than some size left; the empty sum is nearer than one beyond twice.
    top = rest + min(rest, int(sizes[left > 0].max(initial=0)))
    reach, items, full = 1, [], (1 << (top + 1)) - 1
    new_bits: list[int] = []
    for k in order[::-1].tolist():
        size, n, part = int(sizes[k]), min(int(left[k]), top // int(sizes[k])), 1
        while n > 0:
            m = min(part, n)
            grown = (reach | reach << (m * size)) & full
            if fresh := grown & ~reach:
                items.append((k, m))
                new_bits.append(fresh)
                reach = grown
            n -= m
            part *= 2
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    best = below
    if above:
        up = rest + 1 + (above & -above).bit_length() - 1
        if up - rest < rest - below:
            best = up
    # Back through the items: a sum was first reached by one item on top of a sum that was reached before it.
    for (k, m), fresh in zip(reversed(items), reversed(new_bits)):
        if fresh >> best & 1:
            taken[k] += m
            best -= m * int(sizes[k])
    return taken


def targets(by_size: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size, n). One row a source: the only step over all sources at once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(none=frame["source"].isna(), key=[b"" if s is None else s.encode() for s in frame["source"]])
        frame = frame.sort_values(["none", "key"], kind="stable")
        size = frame["source_size"].to_numpy()
        by_weight = np.resize(np.asarray(weights, dtype=float), len(frame))
        return pd.DataFrame({"source": frame["source"], "source_size": size, "target": share(size, by_weight, cap)})

    per_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    kind = by_size.schema["source"].dataType.simpleString()
    return per_source.groupBy(F.lit("all").alias("every")).applyInPandas(run, f"source {kind}, source_size long, target double")


def plan(by_size: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, size, n, source_size, target, passes, extra): all n documents of the size are taken ``passes`` times, ``extra`` of the n once more."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total, goal = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        passes = int(goal // total) if total else 0
        if total and passes < cap and round(goal) - passes * total >= total:
            passes += 1
        sizes, counts = frame["size"].to_numpy(), frame["n"].to_numpy()
        some, rest = sizes > 0, round(goal) - passes * total
        extra = np.zeros(len(frame), dtype=np.int64)
        extra[some] = fit(sizes[some], counts[some], rest)
        off = abs(rest - int((sizes * extra).sum()))
        if off * REPEAT > goal and passes + 1 < cap:
            again = fit(sizes[some], counts[some] * int(cap - passes), rest)
            if abs(rest - int((sizes[some] * again).sum())) < off:
                extra[some] = again
        return frame[["source", "size", "n", "source_size", "target"]].assign(passes=passes + extra // counts, extra=extra % counts)

    kind = by_size.schema["source"].dataType.simpleString()
    joined = by_size.join(goals, by_size["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    # A group is one source's distinct sizes, never its documents.
    return joined.groupBy("source").applyInPandas(run, f"source {kind}, size long, n long, source_size long, target double, passes long, extra long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row of ``docs``; taken counts words, so it is the size times the times the document is taken."""
    order = F.xxhash64(F.lit(seed).cast("long"), F.col("id"))
    slim = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")).withColumn("h", order))
    by_size = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = cut(targets(by_size, weights, cap))
    facts = cut(plan(by_size, goals, cap))
    hot = facts.where(F.col("n") * HOT > slim.count() + HOT).select(F.col("source").alias("s2"), F.col("size").alias("z2"))
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))

    def along(rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``table`` (one row a group): hot groups by broadcast, the others by a shuffle."""
        few = F.broadcast(table.join(F.broadcast(hot), same, "left_semi").withColumnsRenamed({"source": "s2", "size": "z2"}))
        rest = rows.join(F.broadcast(hot), same, "left_anti")
        every = table.withColumnsRenamed({"source": "s2", "size": "z2"})
        return rows.join(few, same).drop("s2", "z2").unionByName(rest.join(every, same).drop("s2", "z2"))

    # The top 31 bits of the hash deal a group's rows to ranges in the order of the hash.
    high = F.shiftright(F.col("h"), 33) + F.lit(1 << 30)
    part = F.floor(high * F.ceil(F.col("n") / F.lit(RANGE)) / F.lit(float(1 << 31))).cast("long")
    known = cut(along(slim, facts).withColumn("part", part))
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    # The range of each group in which the number runs out, and how many of it are taken.
    counts = known.where(some).groupBy("source", "size", "part", "extra").agg(F.count("*").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("before", before).where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("in_part") >= F.col("extra")))
    edge = cut(edge.select("source", "size", F.col("part").alias("edge"), (F.col("extra") - F.col("before")).alias("rest")))

    settled = known.where(~some).withColumn("once_more", F.col("extra") > 0)
    split = along(known.where(some), edge)
    whole = split.where(F.col("part") != F.col("edge")).withColumn("once_more", F.col("part") < F.col("edge"))
    rank = F.row_number().over(W.partitionBy("source", "size").orderBy("h", "id"))
    ranked = split.where(F.col("part") == F.col("edge")).withColumn("once_more", rank <= F.col("rest"))
    every = settled.unionByName(whole.drop("edge", "rest")).unionByName(ranked.drop("edge", "rest"))
    times = F.col("passes") + F.col("once_more").cast("long")
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * times).otherwise(0).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them. Ids must tell documents apart; rows that share an id and a size are taken as often as the one of them taken most."""
    taken = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    times = taken.groupBy(F.col(id_col).alias("__id"), F.col("size").alias("__size")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("__times"))
    joined = docs.join(times, docs[id_col].eqNullSafe(times["__id"]) & (size_of(docs[text_col]) == times["__size"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*[docs[c] for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


QUERIES = {"op8_mixing": op8_mixing}
