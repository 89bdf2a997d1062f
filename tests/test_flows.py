"""Stateful scans and streams against plain loops, and the cases of the operational model."""

import os
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S, text as T
from quern.operators import contained, merge, paging, relate, search, sequences as Q, usage as U
from quern.streaming import coalesce as X


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_todo_batches(spark):
    schema = "session_id string, id long, status string, created_at long, updated_at long"
    rows = [("a", 1, "completed", 1000, 5000), ("a", 2, "in_progress", 1000, 1000), ("a", 3, "pending", 1000, 1000)]
    rows += [("b", 1, "completed", 1000, 3000), ("b", 2, "completed", 1100, 4000), ("b", 3, "pending", 9000, 9000)]
    rows += [("c", 1, "completed", 1000, 3000), ("c", 2, "pending", 2999, 2999)]
    got = sorted((r.session_id, r.id) for r in Q.todo_batches(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 3), ("c", 1), ("c", 2)]


def test_alerts_count_from_the_last_emitted(spark):
    rows = [(1, t) for t in (0, 5, 9, 10, 15, 21)] + [(2, 3)]
    got = Q.emitted_alerts(spark.createDataFrame(rows, "pid long, at long"), "pid", "at", 10).collect()
    assert sorted((r.pid, r["at"]) for r in got) == [(1, 0), (1, 10), (1, 21), (2, 3)]


def test_refused_requests_do_not_count(spark):
    rows = [("k", t) for t in (0, 10, 20, 30, 61, 62, 75)]
    got = Q.rate_limited(spark.createDataFrame(rows, "key string, at long"), "key", "at", 3, 60).orderBy("at").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, False, True]


def test_tail_keeps_calls_with_results_and_stops_at_a_summary(spark):
    schema = "session string, n long, cost long, kind string"
    rows = [("a", i, 10, k) for i, k in enumerate(["user", "summary", "user", "call", "tool_result", "user"])]
    frame = spark.createDataFrame(rows, schema)
    tail = lambda budget: [r.n for r in Q.realigned_tail(frame, "session", "n", "cost", "kind", budget).orderBy("n").collect()]
    assert tail(20) == [3, 4, 5]
    assert tail(1000) == [1, 2, 3, 4, 5]
    assert tail(0) == [3, 4, 5]  # two at least, and the call of the result


def log(*events):
    return [("run-1", k, a if k != "tool_use_args_delta" else None, b, a if k == "tool_use_args_delta" else None, i) for i, (k, a, b) in enumerate((e + (None,) * 3)[:3] for e in events)]


EVENTS = "run_id string, type string, text string, tool_call_id string, args string, arrival long"


def replayed(spark, rows, **kw):
    return [(r.seq, r.type, r.text, r.tool_call_id, r.args) for r in X.replay(spark.createDataFrame(rows, EVENTS), **kw).orderBy("seq").collect()]


def test_coalescer_cases(spark):
    assert replayed(spark, log(("text_delta", "你"), ("text_delta", "好"), ("text_delta", "啊"))) == [(0, "text_delta", "你好啊", None, None)]
    got = replayed(spark, log(("thinking_delta", "想"), ("text_delta", "说"), ("thinking_delta", "完")))
    assert [(k, t) for _, k, t, _, _ in got] == [("thinking_delta", "想"), ("text_delta", "说"), ("thinking_delta", "完")]
    got = replayed(spark, log(("tool_use_args_delta", '{"a":1}', "t"), ("tool_use_args_delta", '{"a":1,"b":2}', "t")))
    assert [(i, a) for *_, i, a in got] == [("t", '{"a":1,"b":2}')]
    run = X.Run(size=10)
    assert run.push("text_delta", "123456789", None, None) == [] and run.push("text_delta", "0", None, None) == [(0, "text_delta", "1234567890", None, None)]
    got = replayed(spark, log(("text_delta", "a"), ("loop_end",), ("text_delta", "b")))
    assert [(s, k) for s, k, *_ in got] == [(0, "text_delta"), (1, "loop_end"), (0, "text_delta")] or sorted(s for s, *_ in got) == [0, 0, 1]


def test_stream_gives_what_the_replay_gives(spark, tmp_path):
    rows = log(*[(("text_delta", "thinking_delta", "step")[i % 7 % 3], f"x{i}") for i in range(60)], ("loop_end",))
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    run = X.coalesce_stream(stream, size=6, flush_ms=3_600_000).writeStream.format("memory").queryName("coalesced").outputMode("append").trigger(once=True).start()
    run.awaitTermination()
    assert sorted((r.seq, r.text) for r in spark.table("coalesced").collect()) == sorted((s, t) for s, _, t, *_ in replayed(spark, rows, size=6))


def test_slots(spark):
    rows = [("r", 0, "text", "b", 3), ("r", 0, "thinking", "a", 1), ("r", 0, "text", "c", 4), ("r", 0, "tool_use", "t1", 5), ("r", 1, "text", "x", 6), ("r", 1, "thinking", "y", 7)]
    got = X.slots(spark.createDataFrame(rows, "run_id string, iteration long, kind string, value string, arrival long")).orderBy("iteration", "ord").collect()
    assert [(r.iteration, r.kind, r.content, r.completed) for r in got] == [(0, "thinking", "a", True), (0, "text", "bc", False), (0, "tool_use", "t1", False), (1, "thinking", "y", False), (1, "text", "x", False)]


def test_usage_cases(spark):
    schema = "status string, attempt_index int, input_tokens long, billable_input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, reasoning_tokens long, total_cost_usd double, duration_ms long, ttft_ms long, started_at long, provider_id string, model_id string, provider_type string"
    row = lambda s, a, b, t, p: (s, a, b, b, 0, 0, 0, 0, None, 5, None, t, p, "m", "x")
    at = 1_789_138_800_000  # 2026-09-11T15:00Z
    logs = spark.createDataFrame([row("success", 1, 1000, at, None), row("success", 1, 2000, at, U.UNKNOWN), row("error", 2, 500, at + 5 * U.HOUR, "p")], schema)
    one = U.overview(logs).first()
    assert (one.request_count, one.success_count, one.error_count, one.retry_count, one.billable_input_tokens, one.total_cost_usd) == (3, 2, 1, 1, 3500, None)
    none = U.overview(logs.where("false")).first()
    assert (none.request_count, none.input_tokens, none.total_cost_usd, none.avg_duration_ms) == (0, 0, None, None)
    days = U.buckets(logs, at - U.DAY, at + U.DAY, U.DAY, 480, fill=False).collect()
    assert len(days) == 2
    series = {(r.provider_id): r.request_count for r in U.model_buckets(logs, at - U.DAY, at + U.DAY, U.DAY).collect()}
    assert series == {U.UNKNOWN: 2, "p": 1}
    now = at + 30 * 60_000
    hours = U.buckets(logs, now - U.DAY, now, U.HOUR).collect()
    assert len(hours) in (24, 25) and sum(r.request_count > 0 for r in hours) == 1


@pytest.mark.parametrize("n,want", [(0, "0"), (-1, "0"), (float("nan"), "0"), (850, "850"), (999.6, "1.00k"), (1234, "1.23k"), (9999, "10.0k"), (12500, "12.5k"), (99999, "100k"), (999999, "1.00M"), (1127850000, "1.13B"), (1e12, "1.00T")])
def test_short_numbers(spark, n, want):
    assert spark.range(1).select(S.short_number(F.lit(float(n))).alias("x")).first().x == want


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    diff = one(T.line_diff(F.lit("a\nb\nc"), F.lit("a\nx\nc\nd")))
    assert [(r["op"], r["line"]) for r in diff] == [(" ", "a"), ("-", "b"), ("+", "x"), (" ", "c"), ("+", "d")]
    assert T.diff_lines(["a", "b", "c"], ["a", "c"], 0) == [{"op": " ", "line": "a"}, {"op": "-", "line": "b"}, {"op": " ", "line": "c"}]
    assert one(T.fnv1a(F.lit("hello"))) == "4f9f2cab"
    assert one(T.canonical_json(F.lit('{"b": [1, {"z": 1, "a": "é"}], "a": null}'))) == '{"a":null,"b":[1,{"a":"é","z":1}]}'
    cut = one(S.truncate_middle(F.lit("é" * 100), 50))
    assert len(cut) < 90 and cut.startswith("é" * 12) and cut.endswith("é" * 12) and "left out" in cut
    assert one(S.truncate_middle(F.lit("short"), 50)) == "short"
    assert one(S.strip_block(F.lit("a<m>x\n</m>b<m>open"), "m")) == "ab"
    day, after = one(S.local_day("2026-03-29", "Europe/Berlin")[0]), one(S.local_day("2026-03-29", "Europe/Berlin")[1])
    assert after - day == 23 * U.HOUR


def test_search_cases(spark):
    schema = "id long, scope string, title string, content string, status string, updated_at long"
    rows = [(1, "g", "短词 标题命中", "other", "active", 90), (2, "g", "无关标题", "短词 x", "active", 100), (3, "g", "记忆 整理 配置", "other", "active", 80), (4, "g", "x", "记忆 整理 y", "warm", 100), (5, "g", "记忆 单独", "z", "active", 110), (6, "p", 'say "hello"', "<memory-recall> OR token alpha:beta (gamma)", "active", 1)]
    notes = spark.createDataFrame(rows, schema)
    assert [r.id for r in search.search(notes, "短词").collect()] == [1, 2]
    assert [(r.id, r.score) for r in search.search(notes, "记忆 整理").collect()] == [(3, 4.0), (4, 2.0)]
    for words in ("<memory-recall>", '"hello"', "OR token", "alpha:beta (gamma)"):
        hits = search.search(notes, words).collect()
        assert [r.id for r in hits] == [6] and hits[0].score > 0
    assert search.search(notes, "  ").collect() == [] and search.search(notes, "短词", 0).collect() == []
    assert [r.id for r in search.recall(notes, ["nothing", "短词"], 5, scope="p").collect()] == [1, 2]
    assert search.recall_reason(" ", 0, 0, 0) == "empty_message" and search.recall_reason("x", 2, 1, 1) == "injected"
    assert search.render([{"title": "t", "content": "c" * 5000}, {"title": "u", "content": "d"}], 2010) == f"- t: {'c' * 2000}\n"
    pages = spark.createDataFrame([(1, "g", "https://www.a.b/x/", "Hello world"), (2, "g", "http://a.b/x", "Other"), (3, "g", "http://a.b/y", "Hello world!"), (4, "g", "http://a.b/z", "Quite else")], "id long, g string, url string, title string")
    assert ids(search.near_duplicates(pages, "g", S.normal_url(F.col("url")), "title", "id")) == [1, 4]


def test_relations(spark):
    new = spark.createDataFrame([(0, "alpha beta"), (1, "alpha"), (2, "gamma delta"), (3, "zeta"), (4, "zeta eta")], "position long, text string")
    known = spark.createDataFrame([("x gamma delta y",)], "text string")
    assert sorted(r.text for r in contained.not_contained(new, known, "text").collect()) == ["alpha beta", "zeta"]
    prices = spark.createDataFrame([(0, [("m", 1.0), ("n", 2.0)]), (1, [("m", 9.0)])], "position long, models array<struct<id:string,price:double>>")
    rows = spark.createDataFrame([("m",), ("n",), ("o",)], "model string")
    assert sorted((r.model, r.price) for r in relate.lookup_first(rows, prices, "models", "id", "price", "model", "price").collect()) == [("m", 1.0), ("n", 2.0), ("o", None)]
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    copy = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k long, v string")
    assert {r.kind: r.n for r in merge.verify_copy(old, copy, ["k"]).collect()} == {"changed": 1, "missing": 1, "added": 1}
    rows = spark.range(7)
    got = paging.keyset(rows, [("id", "asc")], 3, [1]).collect()
    assert [r.id for r in got] == [2, 3, 4] and all(r.has_more for r in got)
    last = paging.keyset(rows, [("id", "asc")], 3, [3]).collect()
    assert [r.id for r in last] == [4, 5, 6] and not any(r.has_more for r in last)  # an exactly full last page


def test_csv_and_file_scans(spark, tmp_path):
    from quern.sources import grids

    (tmp_path / "a.csv").write_text('x,"y ""q"" z",\n,,\n1\t2\t3\n"m\nn",o,p\n')
    rows = grids.read_grid(spark, str(tmp_path / "a.csv")).orderBy("row_no").collect()
    assert [list(r.cells) for r in rows] == [["x", 'y "q" z', ""], ["1", "2", "3"], ["m\nn", "o", "p"]]
    assert grids.csv_line(["a,b", 'q"', "n\nl", None]) == '"a,b","q""","n\nl",'
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("a\r\nb\rc")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "n.py").write_text("skip")
    found = T.files(spark, str(tmp_path), "*.py")
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["m.py"]
    assert [(r.line_no, r.line) for r in T.lines(found).orderBy("line_no").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_fingerprints_are_of_whole_texts(spark, tmp_path):
    def plain(t):
        h, data = 0x811C9DC5, t.encode("utf-16-le", "surrogatepass")
        for i in range(0, len(data), 2):
            h = (h ^ (data[i] | data[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
        return f"{h:08x}"

    from quern.plans import registry

    texts = ["", "a", "é中😀", "x" * 200 + "a", "x" * 200 + "b", "y" * 5000, None] + [f"{i} " * (i % 50) for i in range(300)]
    for most in (1, 700, 4_000_000):
        assert T.fnv1a_hashes(texts, most) == [None if t is None else plain(t) for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hash for r in registry.queries()["fingerprints_fnv"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_line_diffs_take_every_document(spark, tmp_path):
    from quern.plans import registry

    texts = {1: "a. b\nc", 2: "same\nlines", 7: "x. x. x", 10: "p. q", 23: "one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.added, r.deleted) for r in registry.queries()["line_diffs"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1), 2: (0, 0), 7: (3, 1), 10: (2, 1), 23: (0, 0)}


def test_near_duplicate_pages_meet_across_hosts(spark, tmp_path):
    import random

    from quern.plans import registry

    def pairs(t):
        t = "".join(t.lower().split())
        return {t[i : i + 2] for i in range(len(t) - 1)}

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    near = lambda t: t if rnd.random() < 0.3 else t + rnd.choice("xyz ") if rnd.random() < 0.5 else t[: rnd.randint(len(t) // 2, len(t))]
    rows = [(0, "http://www.a.com/x", "first title of all"), (1, "http://A.com/x/", "quite something else"), (2, "http://b.org/y", "First title  of all"), (3, "http://c.org/", ""), (4, "http://d.org/", "")]
    rows += [(i, f"http://{rnd.choice(['', 'www.'])}h{rnd.randint(1, 40)}.com/{rnd.randint(1, 6)}", near(rnd.choice(titles))) for i in range(5, 500)]
    plain = lambda u: u.lower().removeprefix("http://").removeprefix("www.").rstrip("/")
    kept, want = [], []
    for i, u, t in rows:
        p = pairs(t)
        if all(plain(u) != v and not (p and q and len(p & q) >= 0.82 * len(p | q)) for v, q in kept):
            kept.append((plain(u), p))
            want.append(i)
    assert want[:3] == [0, 3, 4]
    html = [(i, u, f"<html><title>{t}</title></html>") for i, u, t in rows]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert ids(registry.queries()["near_duplicate_pages"](spark, str(tmp_path)), "page_id") == want


def test_the_stream_gives_what_the_replay_gives(spark):
    from quern.plans import flows
    from quern.streaming import coalesce as X

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(flows.coalesced_event_stream(spark, d)) == rows(X.replay(flows.closed_events(spark, d), size=40))


def test_numbers_like_the_application(spark):
    values = [0, -1, float("nan"), 850, 999.6, 1005, 1125, 1234, 9995, 9999, 10250, 12500, 99999, 500500, 999999, 1127850000, 1e12]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in df.orderBy("i").select(S.short_number(F.col("v")).alias("s")).collect()]
    assert got == ["0", "0", "0", "850", "1.00k", "1.00k", "1.13k", "1.23k", "9.99k", "10.0k", "10.3k", "12.5k", "100k", "501k", "1.00M", "1.13B", "1.00T"]


def test_query_words_of_cjk(spark):
    df = spark.createDataFrame([("帮我优化排序, Please 优化排序 HELP Sort sort x 可以帮忙",), ("hello",), (None,), ("sorting",)], "q string")
    assert [r.w for r in df.select(T.query_variants(F.col("q")).alias("w")).collect()] == [["优化排序", "Sort"], [], None, []]


def test_query_words_of_long_texts(spark):
    """The work grows with the words, not with their square: a text of 40,000 words, and many of 300, within a minute."""
    r = random.Random(5)
    texts = [" ".join(r.choice(("the", "Please", f"w{r.randrange(30)}", f"W{r.randrange(30)}", "排序", "x,y")) for _ in range(300)) for _ in range(400)]
    texts += ["the " * 40_000 + "Last last one", " ".join(f"w{i}" for i in range(40_000)), "  alone ", "", " ", "İx iẋ"]
    want = []
    for t in texts:
        found = {}
        for w in re.split(r"[ ,]+", t.strip(" ")):
            if len(w) >= 2 and w.lower() not in T.STOPWORDS and w.lower() != t.strip(" ").lower():
                found.setdefault(w.lower(), w)
        want.append(list(found.values())[:4])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string").repartition(50).select("i", T.query_variants(F.col("q")).alias("w"))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {row.i: row.w for row in df.collect()}
    finally:
        late.cancel()
    assert [got[i] for i in range(len(texts))] == want


def test_titles_without_letters_are_no_duplicates(spark):
    pages = spark.createDataFrame([(1, "http://a/1", ""), (2, "http://a/2", ""), (3, "http://a/3", "?!"), (4, "http://b/4", "Hello, world"), (5, "http://c/5", "hello world!"), (6, "http://a/1/", "New text")], "id long, url string, title string")
    assert ids(search.near_duplicates(pages, None, S.normal_url(F.col("url")), "title", "id")) == [1, 2, 3, 4]


def test_memory_fingerprint_text(spark):
    df = spark.createDataFrame([("- [2026-01-02] Use `tabs`\n- [2026-01-03]  *Not*  spaces ",)], "t string")
    assert df.select(S.memory_text(F.col("t")).alias("m")).first().m == "use tabs not spaces"


def test_names_by_value_without_case_and_accents(spark):
    names = ["b", "a10", "Ä9", "a9", "A 1", "a123456789012345678901234567890", "a0123456789012345678901234567889", "Zoë2", "zoe 10", "zoe2x", "éa", "", "10", "9"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.name for r in df.orderBy(paging.natural_key(F.col("name")), "i").collect()]
    assert got == ["", "9", "10", "A 1", "Ä9", "a9", "a10", "a0123456789012345678901234567889", "a123456789012345678901234567890", "b", "éa", "zoe 10", "Zoë2", "zoe2x"]
    same = df.select(paging.natural_key(F.col("name")).alias("k")).where("k = 'ZOÉ0000012'").count()
    assert same == 1


def test_tool_calls_become_parts_and_come_back(spark):
    import json

    calls = [{"id": "x", "name": "Read", "input": {"a": 1}, "status": "ok", "startedAt": 5}, "no object", {"id": "y", "error": "e"}]
    metas = {
        1: json.dumps({"toolCalls": calls, "rating": 4}),
        2: json.dumps({"segments": [{"type": "text", "text": "t"}, {"type": "tool_use", "iteration": 1, "toolCallId": "z", "toolName": "Write", "output": "o"}], "toolCalls": [{"id": "z", "name": "Write", "output": "o"}]}),
        3: '{"toolCalls":[]}',
        4: None,
        5: "{broken",
    }
    df = spark.createDataFrame(list(metas.items()), "id int, meta string")
    bare, parts = Q.split_parts(df, "id", "meta")
    assert {r.id: r.meta for r in bare.collect()} == {1: '{"rating":4}', 2: None, 3: '{"toolCalls":[]}', 4: None, 5: "{broken"}
    got = sorted((r.id, r.seq, r.kind, json.loads(r.payload)) for r in parts.collect())
    assert got[0] == (1, 0, "tool_use", {"type": "tool_use", "iteration": 0, "toolCallId": "x", "toolName": "Read", "input": {"a": 1}, "status": "ok", "startedAt": 5})
    assert got[1][:3] == (1, 2, "tool_use") and [g[:3] for g in got[2:]] == [(2, 0, "text"), (2, 1, "tool_use")]
    back = {r.id: json.loads(r.meta) for r in Q.join_parts(bare, parts, "id", "meta").where("id < 3").collect()}
    assert back[1]["toolCalls"] == [calls[0], calls[2]] and back[1]["rating"] == 4
    assert back[2] == json.loads(metas[2])


def test_tail_by_bytes_and_units(spark):
    from quern.functions import text as T

    texts = {1: "ab\ncd", 2: "ééé\nxy\nz", 3: "é" * 5, 4: "😀\nabc", 5: "first line\n"}
    df = spark.createDataFrame(list(texts.items()), "i int, t string")
    got = {}
    for r in T.tail_lines(df, "t", ("i",), 7).orderBy("i", "line_no").collect():
        got.setdefault(r.i, []).append(r.line)
    plain = {}
    for i, t in texts.items():
        b = t.encode()
        if len(b) > 7:
            t = b[-7:].decode("utf-8", "ignore")
            t = t.split("\n", 1)[1] if "\n" in t else t
        plain[i] = t.split("\n")
    assert got == plain
    assert [r.n for r in df.orderBy("i").select(S.utf16_units(F.col("t")).alias("n")).collect()] == [len(t.encode("utf-16-le")) // 2 for t in texts.values()]
