"""Ordered scans: windows where a window can say it, grouped pandas where a row depends on an earlier decision."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quern.operators.chunked import KEY, ROWS, TIE, chain, in_chunks, running_max, scan


def newest(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The ``n`` rows of each key that are last in ``order`` (a unique order). Limited before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return newest(df, 1, keys, order)


def head_and_tail(df: DataFrame, keys: list[str], order: list[str], head: int, tail: int) -> DataFrame:
    """The first ``head`` and last ``tail`` rows of each key."""
    up = W.partitionBy(*keys).orderBy(*order)
    down = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    marked = df.withColumn("__a", F.row_number().over(up)).withColumn("__b", F.row_number().over(down))
    return marked.where((F.col("__a") <= head) | (F.col("__b") <= tail)).drop("__a", "__b")


def segments(df: DataFrame, keys: list[str], order: list[str], kind: str, into: str = "segment") -> DataFrame:
    """A number for each run of rows of one kind."""
    w = W.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__c", change).withColumn(into, F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("__c")


def gaps(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows whose number is beyond the next after the one before: expected and how many are missing."""
    before = F.lag(seq).over(W.partitionBy(*keys).orderBy(seq))
    return df.withColumn("expected", before + 1).where(F.col(seq) > F.col("expected")).withColumn("missing", F.col(seq) - F.col("expected"))


def part_sequence(df: DataFrame, keys: list[str], order: list[str], iteration: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """seq = iteration * 1000 + kind * 100 + ordinal (99 at most); rows without an iteration number from -1e9 in order."""
    ordinal = F.row_number().over(W.partitionBy(*keys, iteration, kind).orderBy(*order)) - 1
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    code = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)) - 1, F.lit(0))
    return df.withColumn("seq", F.when(F.col(iteration).isNull(), F.lit(-1_000_000_000) + place).otherwise(F.col(iteration) * 1000 + code * 100 + F.least(ordinal, F.lit(99))).cast("long"))


def interleave(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first of every group, then the second, and so on (column turn)."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order))).orderBy("turn", group)


def context_lines(lines: DataFrame, keys: list[str], number: str, text: str, hit: Column, around: int) -> DataFrame:
    """Each hit with the lines up to ``around`` before and after it."""
    w = W.partitionBy(*keys).orderBy(number)
    row = F.struct(F.col(number).alias("n"), F.col(text).alias("line"))
    return lines.withColumn("context", F.collect_list(row).over(w.rowsBetween(-around, around))).where(hit)


def turn_page(messages: DataFrame, turns: int, real_turn: Column, session: str = "session_id", time: str = "created_at") -> DataFrame:
    """All messages of a session from its ``turns``-th newest real user turn on, with total_turns and has_more. Equal times stay together."""
    users = messages.where(real_turn).select(session, time)
    w = W.partitionBy(session).orderBy(F.desc(time))
    picked = users.withColumn("n", F.row_number().over(w)).groupBy(session).agg(F.min(F.when(F.col("n") <= turns, F.col(time))).alias("range_start"), F.count("*").alias("total_turns"))
    joined = messages.join(picked, session)
    return joined.where(F.col(time) >= F.col("range_start")).withColumn("has_more", F.col("total_turns") > turns)


def budget_tail(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, least: int = 2) -> DataFrame:
    """The newest rows whose costs add up to ``budget`` at most, and ``least`` in any case."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    marked = df.withColumn("__sum", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return marked.where((F.col("__sum") <= budget) | (F.col("__n") <= least)).drop("__sum", "__n")


def realigned_tail(df: DataFrame, key: str, order: str, cost: str, kind: str, budget: int, least: int = 2) -> DataFrame:
    """``budget_tail`` that never starts on a tool result (its call comes along) and never reaches beyond a summary. State: one session's rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        kinds, costs = frame[kind].tolist(), frame[cost].tolist()
        start, total = len(frame), 0
        while start > 0 and (total + costs[start - 1] <= budget or len(frame) - start < least):
            start -= 1
            total += costs[start]
            if kinds[start] == "summary":
                break
        while 0 < start < len(frame) and kinds[start] == "tool_result":
            start -= 1
        return frame.iloc[start:]

    return df.groupBy(key).applyInPandas(run, df.schema)


def todo_batches(tasks: DataFrame, session: str = "session_id", rows: int = ROWS) -> DataFrame:
    """The last batch of each session's tasks. A task opens a batch if all before it are completed and it was created at or after their last update.

    Whether a batch opens depends on no earlier one: what opened a batch was created after all updates before it, so the
    last update of a batch is that of all tasks so far. Sessions of any size: maxima by chunks, then over chunks.
    """
    order = ["created_at", "id"]
    marked = in_chunks(tasks.withColumn("__left", F.coalesce(F.col("status") != "completed", F.lit(True)).cast("int")), session, order, rows)
    marked = running_max(marked, order, {"__open": "__left", "__seen": "updated_at"})
    opens = F.col("__open").isNull() | ((F.col("__open") == 0) & (F.col("created_at") >= F.col("__seen")))
    place = F.struct(*order, TIE)
    last = marked.where(opens).groupBy(KEY).agg(F.max(place).alias("__first"))
    return marked.join(last, KEY).where(place >= F.col("__first")).select(*tasks.columns)


def emitted_alerts(df: DataFrame, key: str, time: str, gap: int, rows: int = ROWS) -> DataFrame:
    """At most one row of a key in ``gap``, counted from the last one emitted. Links between chunks are worked out while the result is built."""
    return chain(df, key, time, gap, rows)


def rate_limited(df: DataFrame, key: str, time: str, most: int, span: int, rows: int = ROWS) -> DataFrame:
    """Each row with allowed: fewer than ``most`` allowed rows of its key in the ``span`` before it; refused rows don't count. What chunks leave to the next is worked out while the result is built."""

    def run(frame: pd.DataFrame, state: str | None, last: bool) -> tuple[pd.DataFrame, str]:
        held, out = deque(json.loads(state) if state else ()), []
        for t in frame[time].tolist():
            while held and held[0] <= t - span:
                held.popleft()
            out.append(len(held) < most)
            if out[-1]:
                held.append(t)
        end = frame[time].iloc[-1]
        return frame[columns].assign(allowed=out), json.dumps([h for h in held if h > end - span])

    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", allowed boolean"
    return scan(in_chunks(df, key, [time], rows), [time], run, schema)


def last_pair(df: DataFrame, keys: list[str], order: list[str], boundary: Column, summary: Column, time: str, id_: str) -> DataFrame:
    """Each boundary row paired with the first summary row before another boundary; the pair with the largest time (later wins ties). Without a pair: the newest lone summary."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__b", boundary).withColumn("__s", summary).withColumn("__pos", F.row_number().over(w))
    marked = marked.withColumn("__g", F.sum(F.col("__b").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    groups = marked.where("__b OR __s").groupBy(*keys, "__g").agg(
        F.max(F.when(F.col("__b"), F.struct(time, "__pos", id_))).alias("b"), F.min(F.when(F.col("__s"), F.struct("__pos", time, id_))).alias("s")
    )
    best = groups.groupBy(*keys).agg(
        F.max(F.when(F.col("b").isNotNull() & F.col("s").isNotNull(), F.struct(F.col(f"b.{time}"), F.col("b.__pos"), F.col(f"b.{id_}").alias("boundary"), F.col(f"s.{id_}").alias("summary")))).alias("pair")
    )
    lone = marked.where("__s").groupBy(*keys).agg(F.max_by(id_, F.struct(time, "__pos")).alias("lone"))
    return lone.join(best, keys, "left").select(*keys, F.col("pair.boundary").alias("boundary"), F.coalesce("pair.summary", "lone").alias("summary"))


def retained(df: DataFrame, age: Column, most: int, order: list[str], keys: list[str] = (), pinned: Column | None = None) -> DataFrame:
    """Rows young enough, and of those the newest ``most`` of each key; pinned rows always stay and count for nothing."""
    pinned = F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False))
    marked = df.withColumn("__p", pinned).where(F.col("__p") | age)
    w = W.partitionBy(*keys, "__p").orderBy(*[F.desc(c) for c in order])
    return marked.withColumn("__n", F.row_number().over(w)).where(F.col("__p") | (F.col("__n") <= most)).drop("__p", "__n")


#: The fields of a tool call, by their names in a part.
CALL_FIELDS = {"toolCallId": "id", "toolName": "name", "input": "input", "status": "status", "output": "output", "error": "error", "startedAt": "startedAt", "completedAt": "completedAt"}


def _renamed(json: Column, names: dict[str, str], fixed: dict[str, str]) -> Column:
    """A JSON object with the ``fixed`` fields, then those of ``json`` that it has, under their new names (new: old); null if it is no object."""
    old = F.from_json(json, "map<string,variant>")
    entries = [F.struct(F.lit(k).alias("k"), F.parse_json(F.lit(v)).alias("v")) for k, v in fixed.items()]
    entries += [F.struct(F.lit(new).alias("k"), F.try_element_at(old, F.lit(name)).alias("v")) for new, name in names.items()]
    return F.when(old.isNotNull(), F.to_json(F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))))


def split_parts(df: DataFrame, key: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """(rows without the segments and tool calls of their JSON ``meta``, parts): a part (key, seq, kind, payload) for each segment, in order.

    Where there are tool calls but no segments, each call becomes a part of kind tool_use (iteration 0: unknown). A meta that is no
    JSON object or has neither stays as it is; one that held nothing else becomes null.
    """
    listed = lambda name: F.from_json(F.get_json_object(meta, f"$.{name}"), "array<string>")
    some = lambda array: F.coalesce(F.size(array) > 0, F.lit(False))
    segments, calls = listed("segments"), listed("toolCalls")
    made = F.transform(calls, lambda c: _renamed(c, CALL_FIELDS, {"type": '"tool_use"', "iteration": "0"}))
    has = some(segments) | some(calls)
    rest = F.map_filter(F.from_json(meta, "map<string,variant>"), lambda k, _: ~k.isin("segments", "toolCalls"))
    bare = df.withColumn(meta, F.when(~has, F.col(meta)).when(F.size(rest) > 0, F.to_json(rest)))
    parts = df.where(has).select(key, F.posexplode(F.when(some(segments), segments).otherwise(made)).alias("seq", "payload")).where("payload IS NOT NULL").withColumn("kind", F.get_json_object("payload", "$.type"))
    return bare, parts.select(key, "seq", "kind", "payload")


def join_parts(df: DataFrame, parts: DataFrame, key: str, meta: str) -> DataFrame:
    """The inverse of ``split_parts``: rows with their parts put back, in order, before what else their meta holds; tool calls are those that the parts of kind tool_use tell of."""
    call = F.when(F.col("kind") == "tool_use", _renamed(F.col("payload"), {old: new for new, old in CALL_FIELDS.items()}, {}))
    row = F.struct("seq", "payload", call.alias("call"))
    lists = parts.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(row)).alias("__parts"))
    joined = lambda name: F.array_join(F.transform("__parts", lambda p: p[name]), ",")
    rest = F.substring(F.col(meta), 2, F.length(meta))
    tail = F.when(F.col(meta).isNull(), "}").otherwise(F.concat(F.lit(","), rest))
    whole = F.concat(F.lit('{"segments":['), joined("payload"), F.lit('],"toolCalls":['), joined("call"), F.lit("]"), tail)
    return df.join(lists, F.col(key) == F.col("__k"), "left").withColumn(meta, F.when(F.col("__k").isNotNull(), whole).otherwise(F.col(meta))).drop("__k", "__parts")
