"""The coalescer: chunks of a long run against the plain fold, and a stream with its timer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.streaming import coalesce as X

SCHEMA = "run_id string, type string, text string, tool_call_id string, args string, arrival long, at long"


def plain(events, size, flush_ms=None):
    """Envelopes of each run by one loop."""
    out = []
    for run_id in sorted({e[0] for e in events}):
        run, opened = X.Run(size=size), None
        for _, kind, text, tool, args, _, at in sorted((e for e in events if e[0] == run_id), key=lambda e: e[5]):
            if flush_ms is not None and opened is not None and at - opened >= flush_ms:
                out += [(run_id, *e) for e in run.flush()]
                opened = None
            out += [(run_id, *e) for e in run.push(kind, text, tool, args)]
            held = run.state["text"] or run.state["args"]
            opened = (at if opened is None else opened) if held else None
        out += [(run_id, *e) for e in run.flush()]
    return sorted(out, key=str)


def events(seed, n, kinds, runs=("a", "a", "a", "b", "c")):
    r, at = random.Random(seed), 0
    for i in range(n):
        at += r.randrange(20)
        kind = r.choice(kinds)
        text = "".join(r.choice("xy😀") for _ in range(r.randrange(4))) if kind in ("text_delta", "thinking_delta") else None
        tool = f"t{r.randrange(3)}" if kind == "tool_use_args_delta" else None
        yield (r.choice(runs), kind, text, tool, f'{{"n":{i}}}' if tool else None, i, at)


ALL = ("text_delta", "text_delta", "text_delta", "thinking_delta", "tool_use_args_delta", "control", "loop_end")


@pytest.mark.parametrize("kinds", [ALL, ("text_delta",), ("text_delta", "tool_use_args_delta")])
@pytest.mark.parametrize("timed", [False, True])
def test_chunked_replay_equals_the_loop(spark, kinds, timed):
    rows = list(events(1, 260, kinds))
    df = spark.createDataFrame(rows, SCHEMA)
    made = X.replay(df, time="at" if timed else None, size=12, flush_ms=33, rows=40)
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain(rows, 12, 33 if timed else None)


def test_a_table_through_the_stateful_operator(spark):
    rows = [e for e in events(2, 150, ALL)]
    rows += [(r, "loop_end", None, None, None, 1000, 9999) for r in "abc"]
    made = X.coalesce_stream(spark.createDataFrame(rows, SCHEMA), size=12)
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain(rows, 12)


def test_the_timer_flushes_what_no_event_does(spark, tmp_path):
    """Three files, one micro-batch each: state lives on between them, and an open window goes out when its time is over."""
    parts = [[("a", "text_delta", "one ", None, None, 0, 0), ("b", "text_delta", "gone", None, None, 1, 0), ("b", "loop_end", None, None, None, 2, 0)], [("a", "tool_use_args_delta", None, "t", "{}", 3, 0)], [("c", "text_delta", "x", None, None, 4, 0), ("c", "control", None, None, None, 5, 0)]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = X.coalesce_stream(stream, flush_ms=33).writeStream.format("memory").queryName("coalesced").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        deadline = time.time() + 60
        found = lambda: sorted(tuple(r) for r in spark.table("coalesced").select("run_id", "seq", "type", F.coalesce("text", "args").alias("x")).collect())
        while len(found()) < 6 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    rows = found()
    assert [r for r in rows if r[0] != "a"] == [("b", 0, "text_delta", "gone"), ("b", 1, "loop_end", None), ("c", 0, "text_delta", "x"), ("c", 1, "control", None)]
    # Whether both of run a's events were in one window depends on the clock; the timer sent them in any case.
    assert [r[2:] for r in rows if r[0] == "a"] == [("text_delta", "one "), ("tool_use_args_delta", "{}")]


def test_slots_of_a_stream_equal_the_batch_on_shuffled_arrival(spark, tmp_path):
    """Late thinking opens its slot again across micro-batches; one file comes twice."""
    r = random.Random(6)
    rows = [(r.choice("ab"), r.randrange(3), r.choice(["thinking", "text", "text", "tool_use"]), None, i) for i in range(90)]
    rows = [(a, i, k, f"t{n % 4}" if k == "tool_use" else f"x{n} ", n) for a, i, k, _, n in rows]
    schema = "run_id string, iteration long, kind string, value string, arrival long"
    shuffled = r.sample(rows, len(rows))
    # Run c: a text closes the thinking, which a delta in the third file opens again.
    late = [("c", 0, "thinking", "z", 1002)]
    early = [("c", 0, "thinking", "a", 1000), ("c", 0, "text", "b", 1001)]
    rows += early + late
    for i in (0, 30, 60, 30):
        spark.createDataFrame(shuffled[i : i + 30] + {0: early, 60: late}.get(i, []), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = X.slot_stream(stream).writeStream.format("memory").queryName("slots_seen").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = sorted(tuple(x) for x in X.newest_slots(spark.table("slots_seen")).collect())
    batch = X.slots(spark.createDataFrame(rows, schema)).select("run_id", "iteration", "kind", "ord", "content", "completed")
    assert found == sorted(tuple(x) for x in batch.collect()) and any(x[-1] for x in found)
    states = spark.table("slots_seen").where("run_id = 'c' AND kind = 'thinking'").orderBy("seen").collect()
    assert [(x.content, x.completed) for x in states] == [("a", True), ("az", False)]
