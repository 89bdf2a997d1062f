"""Text, history, search, note and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalar as S, text as T
from quern.operators import search as K, sequences as Q, usage as U
from quern.operators.contained import not_contained
from quern.plans.kit import Catalog
from quern.sources.standins import memory_entries, messages, read

C = Catalog()
query, QUERIES, ORACLE_SQL = C.query, C.queries, C.sql


def real_turn():
    return (F.col("role") == "user") & (F.col("meta").isNull() | ~F.col("meta").contains("compactSummary"))


_REAL = "role = 'user' AND (meta IS NULL OR meta NOT LIKE '%compactSummary%')"


# Message history.


@query(f"SELECT id FROM messages WHERE {_REAL}", "messages")
def real_user_turns(spark, d):
    return messages(spark, d).where(real_turn()).select("id")


@query(f""", t AS (SELECT session_id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS n FROM messages WHERE {_REAL}),
 p AS (SELECT session_id, min(created_at) FILTER (n <= 2) AS range_start, count(*) AS total_turns FROM t GROUP BY 1)
 SELECT m.id AS id, p.total_turns AS total_turns, p.total_turns > 2 AS has_more FROM messages m JOIN p ON m.session_id = p.session_id WHERE m.created_at >= p.range_start""", "messages")
def turn_pages(spark, d):
    return Q.turn_page(messages(spark, d), 2, real_turn()).select("id", "total_turns", "has_more")


@query("""SELECT id, CASE WHEN hit > 0 THEN (CASE WHEN s > 1 THEN '...' ELSE '' END) || substring(flat, s, e - s) || (CASE WHEN e <= length(flat) THEN '...' ELSE '' END) ELSE substring(flat, 1, 50) END AS snippet
 FROM (SELECT *, greatest(hit - 20, 1) AS s, least(hit + 4 + 30, length(flat) + 1) AS e FROM (SELECT id, replace(replace(content, chr(10), ' '), chr(13), ' ') AS flat, instr(lower(replace(replace(content, chr(10), ' '), chr(13), ' ')), 'tion') AS hit FROM messages))""", "messages")
def message_snippets(spark, d):
    return messages(spark, d).select("id", S.snippet(F.col("content"), "tion").alias("snippet"))


@query("SELECT id, content FROM messages WHERE role = 'user' AND created_at >= epoch_ms(TIMESTAMP '2023-11-16 18:30:00') AND created_at < epoch_ms(TIMESTAMP '2023-11-17 18:30:00') ORDER BY created_at, id", "messages")
def user_messages_of_a_day(spark, d):
    start, end = S.local_day("2023-11-17", "Asia/Kolkata")
    return messages(spark, d).where((F.col("role") == "user") & (F.col("created_at") >= start) & (F.col("created_at") < end)).select("id", "content").orderBy("created_at", "id")


@query("""SELECT session_id, count(*) AS requests, sum(greatest(0, length(content) - sort_order))::BIGINT AS billable, sum(CASE WHEN session_id % 4 = 0 THEN 0 ELSE length(content) END)::BIGINT AS input_tokens FROM messages WHERE role = 'assistant' AND session_id % 4 <> 3 GROUP BY 1""", "messages")
def session_usage_stats(spark, d):
    rows = messages(spark, d).where("role = 'assistant'")
    # The usage column as JSON text; a number given as a string counts 0, a broken document is skipped.
    number = F.when(F.col("session_id") % 4 == 0, F.concat(F.lit('"'), F.length("content"), F.lit('"'))).otherwise(F.length("content").cast("string"))
    text = F.concat(F.lit('{"inputTokens":'), number, F.lit(',"billableInputTokens":'), F.greatest(F.lit(0), F.length("content") - F.col("sort_order")), F.lit(',"requestTimings":[1]}'))
    usage = F.when(F.col("session_id") % 4 == 3, "{broken").otherwise(text)
    parsed = F.from_json(usage, "inputTokens double, billableInputTokens double, cacheReadTokens double, cacheCreationTokens double, requestTimings array<int>, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.withColumn("u", parsed).where((usage != "{broken") & F.col("u").isNotNull())
    tokens = F.coalesce("u.inputTokens", F.lit(0.0))
    billable = F.coalesce("u.billableInputTokens", S.billable_input(tokens, F.col("u.cacheReadTokens"), F.col("u.cacheCreationTokens")))
    return rows.groupBy("session_id").agg(F.sum(F.greatest(F.coalesce(F.size("u.requestTimings"), F.lit(1)), F.lit(1))).cast("long").alias("requests"), F.sum(billable).cast("long").alias("billable"), F.sum(tokens).cast("long").alias("input_tokens"))


@query("SELECT id, '[image]: ' || (session_id % 3 + 1) AS summary FROM messages WHERE role = 'user' AND session_id % 3 <> 2", "messages")
def attachment_summaries(spark, d):
    n = F.col("session_id") % 3 + 1
    block = lambda kind: F.lit(f'{{"type":"{kind}"}}')
    meta = F.concat(F.lit('{"content":['), block("text"), F.repeat(F.concat(F.lit(","), block("image")), n.cast("int")), F.lit("]}"))
    rows = messages(spark, d).where("role = 'user' AND session_id % 3 <> 2").withColumn("m", meta)
    images = F.size(F.filter(F.from_json("m", "content array<struct<type:string>>")["content"], lambda b: b["type"] == "image"))
    return rows.select("id", F.concat(F.lit("[image]: "), images).alias("summary"))


@query("SELECT id, trim(content) AS content, '[block]' || trim(content) AS flat, '<b>&amp;lt;' AS back FROM messages", "messages")
def strip_injected_blocks(spark, d):
    rows = messages(spark, d)
    held = F.concat(F.lit("<recall>x\ny</recall>"), F.col("content"), F.lit("<recall>open"))
    return rows.select("id", S.strip_block(held, "recall").alias("content"), F.concat(S.flatten_blocks(F.lit("<block>a\nb</block>"), "block"), F.trim("content")).alias("flat"), S.unescape(F.lit("&lt;b&gt;&amp;amp;lt;")).alias("back"))


@query("SELECT id, length(content) + length(regexp_replace(content, '[^\U00010000-\U0010ffff]', '', 'g')) AS tokens FROM messages", "messages")
def token_estimates(spark, d):
    n = S.utf16_units(F.col("content"))
    return messages(spark, d).select("id", F.greatest(F.ceil(n / 4), n).alias("tokens"))


# Notes.


@query("SELECT count(*) AS entries, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'warm') AS warm, count(*) FILTER (status IN ('cold', 'deprecated')) AS cold FROM memory", "memory")
def memory_stats(spark, d):
    one = lambda *s: F.count_if(F.col("status").isin(*s))
    return memory_entries(spark, d).agg(F.count("*").alias("entries"), one("active").alias("active"), one("warm").alias("warm"), one("cold", "deprecated").alias("cold"))


_DEMOTE = """SELECT id, CASE WHEN idle >= cold AND status IN ('active', 'warm') THEN 'cold' WHEN idle >= warm AND status = 'active' THEN 'warm' END AS target FROM (
 SELECT id, status, (1700000000 - updated_at) // 86400 AS idle, CASE priority WHEN 'ephemeral' THEN 7 WHEN 'lasting' THEN 90 ELSE 30 END AS warm, CASE priority WHEN 'ephemeral' THEN 21 WHEN 'lasting' THEN 180 ELSE 90 END AS cold FROM memory)"""


def _demotions(spark, d):
    idle = ((F.lit(1_700_000_000) - F.col("updated_at")) / 86_400).cast("int")
    rows = memory_entries(spark, d).select("id", S.demotion(F.col("priority"), F.col("status"), idle).alias("target"))
    return rows.where("target IS NOT NULL")


@query(f"SELECT * FROM ({_DEMOTE}) WHERE target IS NOT NULL", "memory")
def demotion_candidates(spark, d):
    return _demotions(spark, d)


@query(f"SELECT target, count(*) AS n FROM ({_DEMOTE}) WHERE target IS NOT NULL GROUP BY 1", "memory")
def demotion_counts(spark, d):
    return _demotions(spark, d).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT id FROM memory WHERE updated_at >= 1690000000 AND updated_at <= 1699913600 AND status = 'active' ORDER BY updated_at DESC, id LIMIT 100", "memory")
def memory_in_range(spark, d):
    rows = memory_entries(spark, d).where(U.in_closed_range("updated_at", 1_690_000_000, 1_699_913_600) & (F.col("status") == "active"))
    return rows.orderBy(F.desc("updated_at"), "id").limit(100).select("id")


@query("""SELECT id, score FROM (SELECT id, status, updated_at, (CASE WHEN contains(lower(title), 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'of') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content), 'of') THEN 1 ELSE 0 END)::DOUBLE AS score
 FROM memory WHERE (contains(lower(title), 'tion') OR contains(lower(content), 'tion')) AND (contains(lower(title), 'of') OR contains(lower(content), 'of')) AND status IN ('active', 'warm')) ORDER BY status <> 'active', score DESC, updated_at DESC, id LIMIT 10""", "memory")
def search_by_like(spark, d):
    return K.search(memory_entries(spark, d), "tion OF tion").select("id", "score")


@query("""SELECT id, round(score, 9) AS score, 'rank' AS channel FROM (SELECT *, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS score FROM (
 SELECT *, count(*) OVER () AS n, avg(len) OVER () AS avg_len, count(*) FILTER (tf > 0) OVER () AS df FROM (SELECT *, (length(both_) - length(replace(both_, 'worthless', ''))) / 9 AS tf, greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0) AS len
 FROM (SELECT *, lower(title || chr(10) || chr(10) || chr(10) || content) AS both_ FROM memory))) WHERE tf > 0 AND status IN ('active', 'warm')) ORDER BY status <> 'active', score DESC, updated_at DESC, id LIMIT 20""", "memory")
def search_by_rank(spark, d):
    return K.search(memory_entries(spark, d), "worthless", 20).select("id", F.round("score", 9).alias("score"), "channel")


@query()
def recall_with_variants(spark, d):
    return K.recall(memory_entries(spark, d), ["worthless clown", "worthless", "clown"], 8, 0.5, scope="src3").select("id", "query_no", "rank", F.round("score", 6).alias("score"), "channel")


# Text.


@query("SELECT doc_id, n AS line_no, line FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents))")
def text_lines(spark, d):
    return T.lines(read(spark, d, "documents"), "text", ("doc_id",)).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, n AS line_no, line FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE n BETWEEN 2 AND 4")
def text_line_range(spark, d):
    return T.line_range(read(spark, d, "documents"), "text", 2, 3, ("doc_id",)).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, n AS line_no FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '^[A-Z]\\S+ (the|and) ', 'i')")
def text_grep(spark, d):
    rows = T.lines(read(spark, d, "documents"), "text", ("doc_id",))
    return rows.where(F.col("line").rlike(r"(?i)^[A-Z]\S+ (the|and) ")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT doc_id, n AS line_no, k AS context_no, l[k] AS line FROM (SELECT doc_id, n, l, unnest(generate_series(greatest(1, n - 1), least(len(l), n + 1))) AS k FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(l[n], 'licensed'))""")
def text_grep_context(spark, d):
    rows = T.lines(read(spark, d, "documents"), "text", ("doc_id",))
    found = Q.context_lines(rows, ["doc_id"], "line_no", "line", F.contains(F.col("line"), F.lit("licensed")), 1)
    flat = found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.explode("context").alias("c"))
    return flat.select("doc_id", "line_no", F.col("c.n").cast("long").alias("context_no"), F.col("c.line").alias("line"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://www\\.[^/]*/en/[^/]*\\.html$') ORDER BY url, page_id LIMIT 100")
def glob_pages(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    return pages.where(F.col("url").rlike(T.glob_regex("http{s,}://www.*/en/*.html"))).orderBy("url", "page_id").limit(100)


@query("SELECT doc_id, s AS section_no, CASE s WHEN 1 THEN 'T ' || source ELSE 'T2' END AS title, CASE s WHEN 1 THEN 'body ' || lang || ' ' || doc_id ELSE 'body ' || n_chars END AS body FROM documents, (VALUES (1), (2)) v(s)")
def markdown_sections(spark, d):
    ids = read(spark, d, "documents").select("doc_id", F.concat(F.lit("intro\n## T "), "source", F.lit("\nbody "), "lang", F.lit(" "), F.col("doc_id"), F.lit("## T2\nbody "), F.col("n_chars"), F.lit("\n")).alias("md"))
    # A glued heading: "body 7## T2" is repaired first.
    return T.sections(ids, "md", ("doc_id",)).withColumn("section_no", F.col("section_no").cast("int"))


@query("SELECT doc_id, 'note ' || doc_id AS title, CASE doc_id % 4 WHEN 0 THEN 'lasting' WHEN 1 THEN 'lasting' WHEN 2 THEN 'standard' ELSE 'ephemeral' END AS priority FROM documents")
def front_matter_fields(spark, d):
    md = F.concat(F.lit("---\ntitle: \"note "), F.col("doc_id"), F.lit("\"\npriority: P"), F.col("doc_id") % 4, F.lit("\ntitle: again\n---\nbody"))
    head = T.front_matter(md)
    return read(spark, d, "documents").select("doc_id", head["title"].alias("title"), T.priority_of(head["priority"]).alias("priority"))


@query("SELECT doc_id, 'h' || doc_id AS hash, source AS author, 'msg' || chr(1) || 'x' AS subject FROM documents WHERE doc_id % 2 = 0")
def separated_log(spark, d):
    sep = "\u0001"
    line = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(sep, F.concat(F.lit("h"), F.col("doc_id")), "source", F.lit("msg"), F.lit("x"))).otherwise("broken")
    return T.separated(read(spark, d, "documents").select("doc_id", line.alias("line")), "line", ("hash", "author", "subject"))


@query("SELECT count(*) AS files, coalesce(sum(CASE WHEN doc_id % 10 > 0 THEN n_chars END), 0)::BIGINT AS added, coalesce(sum(CASE WHEN doc_id % 10 > 0 THEN doc_id END), 0)::BIGINT AS removed, count(*) FILTER (doc_id % 10 = 0) AS binary FROM documents")
def numstat_totals(spark, d):
    num = lambda c: F.when(F.col("doc_id") % 10 == 0, "-").otherwise(F.col(c).cast("string"))
    return T.numstat(read(spark, d, "documents").select(F.concat_ws("\t", num("n_chars"), num("doc_id"), F.lit("a\tb")).alias("line")))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<head\b.*?</head>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark, d):
    return read(spark, d, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


@query()
def page_link_cards(spark, d):
    return T.link_cards(read(spark, d, "pages"), "html", ("page_id",))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') || lower(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '')) AS url FROM pages""")
def normalized_urls(spark, d):
    return read(spark, d, "pages").select("page_id", S.normal_url(F.col("url")).alias("url"))


@query()
def near_duplicate_pages(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url", T.page_title(F.col("html")).alias("title"))
    return K.near_duplicates(pages, None, S.normal_url(F.col("url")), "title", "page_id").select("page_id")


@query()
def search_results_on_topic(spark, d):
    """Pages as results of a search: near-duplicates go, pages that share no word with the query are deferred behind the others."""
    pages = read(spark, d, "pages").select("page_id", "url", T.page_title(F.col("html")).alias("title"))
    topic = K.shares_token("the nation of things", F.col("title"), F.lit(""))
    return K.near_duplicates(pages, None, S.normal_url(F.col("url")), "title", "page_id", on_topic=topic).select("page_id", "deferred")


@query()
def paragraphs_not_known(spark, d):
    """The paragraphs of all messages, in order, that are no part of a benchmark text or of an earlier paragraph that stays, and have none as a part."""
    parts = T.paragraphs(messages(spark, d).select("session_id", "sort_order", "content"), "content", ("session_id", "sort_order"), 12)
    new = parts.select((F.col("session_id") * 1_000_000 + F.col("sort_order") * 1000 + F.col("position")).alias("position"), S.title_key(F.col("paragraph")).alias("text"))
    known = read(spark, d, "benchmark").select(S.title_key(F.col("text")).alias("text"))
    return not_contained(new, known, "text")


@query("SELECT doc_id, position, paragraph FROM (SELECT doc_id, position, trim(p) AS paragraph FROM (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS position, unnest(l) AS p FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM documents))) WHERE length(paragraph) >= 20")
def text_paragraphs(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return T.paragraphs(docs, "text", ("doc_id",), 20).withColumn("position", F.col("position").cast("long"))


@query("""SELECT doc_id, line, line_no, times, total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS n, sum(times) OVER (PARTITION BY doc_id)::BIGINT AS total FROM (SELECT doc_id, lower(trim(line)) AS line, max(n) AS line_no, count(*) AS times
 FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(lower(line), 'license') OR contains(lower(line), 'idiot') GROUP BY 1, 2)) WHERE n <= 3""")
def notable_text_lines(spark, d):
    return T.notable_lines(read(spark, d, "documents"), "text", "doc_id", ("license", "idiot"), 3).withColumn("line_no", F.col("line_no").cast("long"))


@query("""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(CASE WHEN strlen(text) <= 500 THEN text WHEN contains(tail, chr(10)) THEN substring(tail, instr(tail, chr(10)) + 1) ELSE tail END, chr(10))) AS line
 FROM (SELECT doc_id, text, decode(unhex(regexp_replace(right(hex(encode(text)), 1000), '^([89AB][0-9A-F]){1,3}', ''))) AS tail FROM documents)) GROUP BY 1""")
def text_tails(spark, d):
    return T.tail_lines(read(spark, d, "documents"), "text", ("doc_id",), 500).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents")
def title_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", S.title_key(F.col("text")).alias("key"))


@query("SELECT doc_id, replace(text, chr(10), chr(10)) AS clean, false AS binary, doc_id % 7 = 0 AS odd FROM documents")
def clean_shell_output(spark, d):
    esc = "\u001b"
    docs = read(spark, d, "documents")
    raw = F.concat(F.lit(f"{esc}[31m"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(f"{esc}[0m"))
    odd = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("a\u0001"), 50)).otherwise("plain text")
    return docs.select("doc_id", S.strip_ansi(raw).alias("clean"), S.looks_binary(F.col("text")).alias("binary"), S.looks_binary(odd).alias("odd"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed') THEN 'license' WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'moron') THEN 'rude' ELSE 'other' END AS intent FROM documents")
def text_intents(spark, d):
    rules = [("license", ("licensed",)), ("rude", ("idiot", "moron"))]
    return read(spark, d, "documents").select("doc_id", S.first_intent(F.col("text"), rules, "other").alias("intent"))


_SECRET_TAILS = (" api_key=abc123 x", " sk-" + "a1B2" * 6 + " x", " ghp_" + "Zz9" * 8 + ".", " AKIA" + "Q7" * 8 + " x", " AIza" + "k_-3" * 7, " xoxb-" + "12-ab" * 5 + " x", "\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nx", " Bearer : t0k x")


def _redacted_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    text = "text || CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {quote(t)}" for k, t in enumerate(_SECRET_TAILS)) + " END"
    for pattern, mark in S.SECRETS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(mark.replace('$1', chr(92) + '1'))}, 'g')"
    return f"SELECT doc_id, sha256({text}) AS clean, sha256(source) AS hash FROM documents"


@query(_redacted_sql())
def redacted_text(spark, d):
    tail = F.element_at(F.array(*map(F.lit, _SECRET_TAILS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.sha2(S.redact(F.concat("text", tail)), 256).alias("clean"), F.sha2("source", 256).alias("hash"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id * 1000 WHEN 1 THEN doc_id * 60000 WHEN 2 THEN doc_id * 3600000 WHEN 3 THEN doc_id * 86400000 END AS millis FROM documents")
def relative_times(spark, d):
    unit = F.element_at(F.array(*map(F.lit, "smhdx")), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", S.relative_millis(F.concat(F.lit("+"), F.col("doc_id"), unit)).alias("millis"))


@query("SELECT doc_id, levenshtein(source, 'src10') AS distance FROM documents")
def edit_distances(spark, d):
    return read(spark, d, "documents").select("doc_id", F.levenshtein("source", F.lit("src10")).cast("long").alias("distance"))


@query()
def fingerprints_fnv(spark, d):
    memory = F.concat(F.lit("mem-"), T.fnv1a(S.memory_text(F.col("text"))))
    return read(spark, d, "documents").select("doc_id", T.fnv1a(F.col("text")).alias("hash"), memory.alias("memory"))


@query()
def line_diffs(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select("doc_id", F.explode(T.line_diff(F.col("text"), F.replace("text", F.lit(". "), F.lit(".\n")))).alias("x"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("x.op") == "+").alias("added"), F.count_if(F.col("x.op") == "-").alias("deleted"))


@query()
def canonical_props(spark, d):
    return read(spark, d, "events").select("event_id", T.canonical_json(F.concat(F.lit('{"z": 1, "a": '), F.col("props"), F.lit("}"))).alias("json"))


@query()
def truncated_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.octet_length(S.truncate_middle(F.col("text"), 4096)).alias("bytes"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 + 1 END AS n, doc_id % 4 < 2 AS shape FROM documents")
def json_shapes(spark, d):
    more = F.col("doc_id") % 4
    item = F.when(more < 2, F.concat(F.lit('{"a":'), F.col("n_chars"), F.lit("}"))).otherwise(F.lit('{"a":"x"}'))
    text = F.when(more == 3, F.concat(F.lit("["), item)).otherwise(F.concat(F.lit("["), item, F.repeat(F.lit(',{"b":1}'), more.cast("int")), F.lit("]")))
    return read(spark, d, "documents").select("doc_id", F.json_array_length(text).cast("long").alias("n"), F.coalesce(F.get_json_object(text, "$[0].a").try_cast("int").isNotNull(), F.lit(False)).alias("shape"))


@query("SELECT p_partkey, NOT contains(cmd, 'rm ') AND starts_with(cmd, 'git') AND seg AS allowed FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'git status' WHEN 1 THEN 'git log; rm x' WHEN 2 THEN 'git log | less' ELSE 'ls' END AS cmd, p_partkey % 4 <> 2 AS seg FROM part)")
def command_policy(spark, d):
    cmd = F.element_at(F.array(*map(F.lit, ("git status", "git log; rm x", "git log | less", "ls"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", T.command_allowed(cmd, ("rm ",), ("git",)).alias("allowed"))


_WORDS = f"""SELECT id, list_slice(list_distinct_in_order, 1, 4) AS words FROM (SELECT id, list_filter(kept, lambda w, i: list_position(list_transform(kept, lambda x: lower(x)), lower(w)) = i) AS list_distinct_in_order FROM (
 SELECT id, list_filter(string_split_regex(trim(content), '[ \\t\\r\\n,.!?;:()\\[\\]{{}}"''/\\\\|，。！？、；：（）《》【】“”‘’…—]+'), lambda w: length(w) >= 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOPWORDS)}], lower(w)) AND lower(w) <> lower(trim(content))) AS kept FROM messages))"""


@query(_WORDS, "messages")
def query_words(spark, d):
    return messages(spark, d).select("id", T.query_variants(F.col("content")).alias("words"))


@query("SELECT id, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS tokens FROM messages", "messages")
def word_tokens(spark, d):
    return messages(spark, d).select("id", F.sort_array(T.word_tokens(F.col("content"))).alias("tokens"))


# JSON: lenient getters; message parts split from and put back into their message.


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN k END AS whole, CASE WHEN event_id % 7 IN (0, 1, 2) THEN k::DOUBLE WHEN event_id % 7 = 3 THEN k + 0.5 END AS number, event_id % 7 IN (4, 5) AS flag
 FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""")
def lenient_json_values(spark, d):
    k = F.get_json_object("props", "$.k")
    forms = (k, F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit('" +'), k, F.lit(' "')), F.concat(k, F.lit(".5")), F.lit("true"), F.lit('" TRUE "'), F.lit("[1]"))
    value = F.element_at(F.array(*forms), (F.col("event_id") % 7 + 1).cast("int"))
    rows = read(spark, d, "events").select("event_id", F.concat(F.lit('{"v":'), value, F.lit("}")).alias("j"))
    return rows.select("event_id", S.json_whole(F.col("j"), "$.v").alias("whole"), S.json_double(F.col("j"), "$.v").alias("number"), S.json_bool(F.col("j"), "$.v", False).alias("flag"))


def _with_meta(spark, d):
    """Messages whose meta holds their content as segments, every third with another key besides, every fifth without any."""
    segment = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[F.col(c).alias(n) for n, c in fields.items()]))
    both = F.concat(F.lit('{"segments":['), segment("text", text="content"), F.lit(","), segment("tool_use", toolCallId="id"), F.lit("]"))
    meta = F.when(F.col("session_id") % 5 == 0, F.lit("{broken")).when(F.col("session_id") % 3 == 0, F.concat(both, F.lit(',"rating":4}'))).otherwise(F.concat(both, F.lit("}")))
    return messages(spark, d).withColumn("meta", meta)


@query("""SELECT id, 0 AS seq, 'text' AS kind, content AS value FROM messages WHERE session_id % 5 <> 0 UNION ALL SELECT id, 1, 'tool_use', id FROM messages WHERE session_id % 5 <> 0""", "messages")
def message_parts(spark, d):
    parts = Q.split_parts(_with_meta(spark, d), "id", "meta")[1]
    value = F.coalesce(F.get_json_object("payload", "$.text"), F.get_json_object("payload", "$.toolCallId"))
    return parts.select("id", "seq", "kind", value.alias("value"))


@query("SELECT id, CASE WHEN session_id % 5 = 0 THEN '{broken' WHEN session_id % 3 = 0 THEN '{\"rating\":4}' END AS meta FROM messages", "messages")
def message_meta_without_parts(spark, d):
    return Q.split_parts(_with_meta(spark, d), "id", "meta")[0].select("id", "meta")


@query("SELECT id, session_id % 5 <> 0 AS has_parts, CASE WHEN session_id % 5 <> 0 THEN content END AS text FROM messages", "messages")
def message_parts_put_back(spark, d):
    rows = _with_meta(spark, d).withColumn("before", F.col("meta"))
    bare, parts = Q.split_parts(rows, "id", "meta")
    whole = Q.join_parts(bare, parts, "id", "meta")
    same = F.col("meta").isNotNull() & F.col("meta").contains("segments")
    return whole.select("id", same.alias("has_parts"), F.get_json_object("meta", "$.segments[0].text").alias("text"))
