"""Micro-batching of delta events per run, the same for batch replay and Structured Streaming.

Text and thinking deltas are joined, of tool arguments the last snapshot of an id counts. A window is flushed when it holds
``size`` characters and arguments, when its time is over, or before an event that may not be reordered: a control event, or
a delta of the other kind. Such an event goes out alone after the flush. Envelopes of a run are numbered from 0; the
numbering and the window end with loop_end or error.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.chunked import CHUNK, KEY, ROWS, in_chunks, scan
from quern.sources.sinks import checkpointed

FLUSH_MS, SIZE = 33, 200
ENDS = ("loop_end", "error")
OUT = "run_id string, seq long, type string, text string, tool_call_id string, args string"
_EMPTY = {"seq": 0, "kind": None, "text": "", "args": {}}


class Run:
    """The window of one run; ``state`` is plain data, so that it can be kept in a state store."""

    def __init__(self, state: dict | None = None, size: int = SIZE):
        self.state, self.size = state or json.loads(json.dumps(_EMPTY)), size

    def _emit(self, events: list[tuple]) -> list[tuple]:
        if not events:
            return []
        seq = self.state["seq"]
        self.state["seq"] += 1
        return [(seq, *e) for e in events]

    def flush(self) -> list[tuple]:
        s, events = self.state, []
        if s["text"]:
            events.append((s["kind"], s["text"], None, None))
        events += [("tool_use_args_delta", None, k, v) for k, v in s["args"].items()]
        s["kind"], s["text"], s["args"] = None, "", {}
        return self._emit(events)

    def push(self, kind: str, text: str | None, tool: str | None, args: str | None) -> list[tuple]:
        s = self.state
        if kind in ("text_delta", "thinking_delta") and (not s["text"] or s["kind"] == kind):
            s["kind"] = kind if text or s["text"] else s["kind"]
            s["text"] += text or ""
        elif kind == "tool_use_args_delta":
            s["args"][tool or ""] = args
        else:
            out = self.flush() + self._emit([(kind, text, tool, args)])
            if kind in ENDS:
                self.state = json.loads(json.dumps(_EMPTY))
            return out
        # Characters are counted as UTF-16 units.
        held = len(s["text"].encode("utf-16-le", "surrogatepass")) // 2 + len(s["args"])
        return self.flush() if held >= self.size else []


def _none(v):
    return None if v is None or v != v else v


def _held(run: Run) -> bool:
    return bool(run.state["text"] or run.state["args"])


def replay(events: DataFrame, order: str = "arrival", time: str | None = None, size: int = SIZE, flush_ms: int = FLUSH_MS, rows: int = ROWS) -> DataFrame:
    """Envelope rows of a whole log (run_id, type, text, tool_call_id, args and ``order``, which is unique in a run); with ``time`` in milliseconds a window also ends ``flush_ms`` after its first event.

    Runs of any length: a run's chunks are folded at once, and again where the window that the chunk before left open makes a
    difference (none after a control event). The numbers of envelopes are counted on over chunks afterwards.
    """

    def fold(frame: pd.DataFrame, state: str | None, last: bool) -> tuple[pd.DataFrame, str]:
        before, opened = json.loads(state) if state else (None, None)
        run, out, epoch, count = Run(before, size), [], 0, 0
        run.state["seq"] = 0
        times = frame[time].tolist() if time else [0] * len(frame)

        def add(made: list[tuple]) -> None:
            nonlocal epoch, count
            for e in made:
                out.append((epoch, *e))
                count = e[0] + 1
                if e[1] in ENDS:
                    epoch, count = epoch + 1, 0

        for at, kind, text, tool, args in zip(times, frame["type"], frame["text"], frame["tool_call_id"], frame["args"]):
            if time and opened is not None and at - opened >= flush_ms:
                add(run.flush())
                opened = None
            add(run.push(kind, _none(text), _none(tool), _none(args)))
            opened = (at if opened is None else opened) if _held(run) else None
        if last:
            add(run.flush())
        id_, key, chunk = (frame[c].iloc[0] for c in ("run_id", KEY, CHUNK))
        # The last row says how many envelopes follow the last end in this chunk, and how many ends it has.
        made = [(id_, key, chunk, *e) for e in out] + [(id_, key, chunk, epoch, count, None, None, None, None)]
        return pd.DataFrame(made, columns=_FOLDED, dtype=object), json.dumps(({**run.state, "seq": 0}, opened))

    made = scan(in_chunks(events, "run_id", [order], rows), [order], fold, f"run_id {dict(events.dtypes)['run_id']}, {KEY} string, {CHUNK} int, epoch int, seq long, type string, text string, tool_call_id string, args string")
    made = checkpointed(made)
    # Envelopes before a chunk, since the last end before it: a window over one row for each chunk.
    by = W.partitionBy(KEY).orderBy(CHUNK)
    chunks = made.where("type IS NULL").select(KEY, CHUNK, "epoch", "seq").withColumn("group", F.sum("epoch").over(by))
    chunks = chunks.withColumn("count", F.sum("seq").over(W.partitionBy(KEY, "group").orderBy(CHUNK)))
    chunks = chunks.select(KEY, CHUNK, F.coalesce(F.lag("count").over(by), F.lit(0)).alias("__before"))
    rows_ = made.where("type IS NOT NULL").join(chunks, [KEY, CHUNK])
    return rows_.select("run_id", (F.col("seq") + F.when(F.col("epoch") == 0, F.col("__before")).otherwise(0)).alias("seq"), "type", "text", "tool_call_id", "args")


_FOLDED = ["run_id", KEY, CHUNK, "epoch", "seq", "type", "text", "tool_call_id", "args"]


class Coalescer(StatefulProcessor):
    """The window of a run in a state store: a value, a map of tool arguments, and one processing-time timer while it holds anything."""

    def __init__(self, order: str, size: int, flush_ms: int):
        self.order, self.size, self.flush_ms = order, size, flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "seq long, kind string, text string, due long")
        # The place keeps the order in which ids came first.
        self.args = handle.getMapState("args", "id string", "place int, args string")

    def _load(self) -> tuple[Run, int | None]:
        if not self.window.exists():
            return Run(size=self.size), None
        seq, kind, text, due = self.window.get()
        kept = sorted((place, k[0], args) for k, (place, args) in self.args.iterator()) if self.args.exists() else []
        return Run({"seq": seq, "kind": kind, "text": text, "args": {k: a for _, k, a in kept}}, self.size), due

    def _keep(self, run: Run, due: int | None) -> None:
        s = run.state
        self.args.clear()
        if s == _EMPTY:
            self.window.clear()
            return
        self.window.update((s["seq"], s["kind"], s["text"], due))
        for place, (k, v) in enumerate(s["args"].items()):
            self.args.updateValue((k,), (place, v))

    def handleInputRows(self, key, rows, timerValues):
        run, due = self._load()
        frame, out = pd.concat(list(rows)).sort_values(self.order, kind="stable"), []
        before = due
        for kind, text, tool, args in zip(frame["type"], frame["text"], frame["tool_call_id"], frame["args"]):
            made = run.push(kind, _none(text), _none(tool), _none(args))
            out += made
            if not _held(run):
                due = None
            elif due is None or made:
                due = timerValues.getCurrentProcessingTimeInMs() + self.flush_ms
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self._keep(run, due)
        yield _rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run, _ = self._load()
        out = run.flush()
        self._keep(run, None)
        yield _rows(key[0], out)

    def close(self) -> None:
        pass


def _rows(run_id: str, events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(run_id, *e) for e in events], columns=["run_id", "seq", "type", "text", "tool_call_id", "args"], dtype=object)


def _state_store(spark: SparkSession) -> None:
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # A session that has run no stream has no one to coordinate state stores yet, which a table needs as well.
    spark.streams.active


def coalesce_stream(events: DataFrame, order: str = "arrival", size: int = SIZE, flush_ms: int = FLUSH_MS) -> DataFrame:
    """The same on a stream: state per run, a timer ``flush_ms`` after a window's first event. Within a micro-batch events go by ``order``. A table instead of a stream gives what one micro-batch would, without timers.

    Needs the state store with column families: it is made the session's, unless another than the default is set.
    """
    _state_store(events.sparkSession)
    return events.groupBy("run_id").transformWithStateInPandas(Coalescer(order, size, flush_ms), OUT, "append", "processingTime")


def sequence_gaps(envelopes: DataFrame) -> DataFrame:
    """Envelopes whose number is beyond the next after the highest before them (a warning, nothing is dropped)."""
    w = W.partitionBy("run_id").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    return envelopes.withColumn("last", F.max("seq").over(w)).where(F.col("seq") > F.col("last") + 1)


#: Order of the slots of an iteration (fixed values).
SLOTS = ("thinking", "text", "tool_use")


def slots(deltas: DataFrame) -> DataFrame:
    """(run_id, iteration, kind, ord, content, completed) from deltas (run_id, iteration, kind, value, arrival): one slot a kind and iteration (tools: one a value), thinking before text before tools. Thinking is completed if a text or tool came after its last delta."""
    key = ["run_id", "iteration"]
    tool = F.when(F.col("kind") == "tool_use", F.col("value"))
    slot = deltas.withColumn("tool", tool).groupBy(*key, "kind", "tool").agg(F.min("arrival").alias("first"), F.max("arrival").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("arrival", "value"))), lambda x: x["value"]), "").alias("content"))
    code = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("kind"))
    w = W.partitionBy(*key)
    other = F.max(F.when(F.col("kind") != "thinking", F.col("last"))).over(w)
    place = F.row_number().over(w.orderBy(code, "first"))
    return slot.select(*key, "kind", place.alias("ord"), F.when(F.col("kind") == "tool_use", F.col("tool")).otherwise(F.col("content")).alias("content"), F.coalesce((F.col("kind") == "thinking") & (other > F.col("last")), F.lit(False)).alias("completed"))


SLOT_OUT = "run_id string, iteration long, kind string, ord int, content string, completed boolean, seen long"


class SlotKeeper(StatefulProcessor):
    """The slots of a run in a state store, by iteration, kind and tool: the deltas so far. Deltas may come late and in any order; a thinking slot that a text has closed opens again when a later delta of it comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "iteration long, kind string, tool string", "deltas string")

    def handleInputRows(self, key, rows, timerValues):
        new: dict[tuple, list] = {}
        for frame in rows:
            for iteration, kind, value, arrival in zip(frame["iteration"], frame["kind"], frame["value"], frame["arrival"]):
                new.setdefault((int(iteration), kind, value if kind == "tool_use" else ""), []).append((int(arrival), value))
        for slot, deltas in new.items():
            held = [tuple(x) for x in json.loads(self.slots.getValue(slot)[0])] if self.slots.containsKey(slot) else []
            # A delta that comes again has its arrival already.
            merged = sorted({a: v for a, v in [*held, *deltas]}.items())
            self.slots.updateValue(slot, (json.dumps(merged),))
        touched = {s[0] for s in new}
        by: dict[int, list[tuple]] = {i: [] for i in touched}
        for (iteration, kind, tool), (deltas,) in self.slots.iterator():
            if iteration in touched:
                by[iteration].append((kind, tool, json.loads(deltas)))
        out = []
        for iteration, found in by.items():
            found.sort(key=lambda f: (SLOTS.index(f[0]), f[2][0][0]))
            other = max((d[-1][0] for kind, _, d in found if kind != "thinking"), default=-1)
            seen = sum(len(d) for _, _, d in found)
            for place, (kind, tool, d) in enumerate(found, 1):
                content = tool if kind == "tool_use" else "".join(v for _, v in d)
                out.append((key[0], iteration, kind, place, content, kind == "thinking" and other > d[-1][0], seen))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SLOT_OUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def slot_stream(deltas: DataFrame) -> DataFrame:
    """``slots`` on a stream of (run_id, iteration, kind, value, arrival): after each micro-batch all slots of the iterations it touched, with the number of deltas ``seen`` in the iteration, by which the last state of a slot is told. See ``coalesce_stream`` for the state store."""
    _state_store(deltas.sparkSession)
    return deltas.groupBy("run_id").transformWithStateInPandas(SlotKeeper(), SLOT_OUT, "update", "none")


def newest_slots(emitted: DataFrame) -> DataFrame:
    """The last state of each iteration's slots out of what ``slot_stream`` has given."""
    last = F.max("seen").over(W.partitionBy("run_id", "iteration"))
    return emitted.withColumn("__last", last).where(F.col("seen") == F.col("__last")).drop("__last", "seen").distinct()


def sse_deltas(lines: DataFrame, line: str = "line") -> DataFrame:
    """The JSON payloads of "data:" lines of a server-sent event log, up to [DONE], as (…, delta, finish_reason)."""
    data = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    rows = lines.withColumn("data", data).where((F.col("data") != "") & (F.col("data") != "[DONE]"))
    choice = F.from_json("data", "choices array<struct<delta:struct<content:string>,finish_reason:string>>")["choices"]
    return rows.withColumn("delta", F.get(choice, 0)["delta"]["content"]).withColumn("finish_reason", F.get(choice, 0)["finish_reason"]).drop("data")


def tumbling(events: DataFrame, time: str, span: str, late: str, keys: list[str] = ()) -> DataFrame:
    """Counts in event-time windows with a watermark (an extension: late rows beyond it are dropped by the stream)."""
    return events.withWatermark(time, late).groupBy(F.window(time, span), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
