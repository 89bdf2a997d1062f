"""Text scans and small text algorithms on columns and frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Folders that a file scan leaves out unless asked (fixed values of this library).
SKIPPED = ("node_modules", "target", "dist", "build", "__pycache__", "vendor", "bin", "obj", "out", "coverage")


def lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a line: line_no from 1, line; CRLF and CR end lines, too."""
    parts = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return df.select(*keep, F.posexplode(parts).alias("__p", "line")).select(*keep, (F.col("__p") + 1).alias("line_no"), "line")


def files(spark, folder: str, glob: str = "*", skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, text) of the text files below ``folder`` whose names fit ``glob``, without hidden and skipped folders."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    inner = F.slice(F.split(F.substring_index("path", folder.rstrip("/"), -1), "/"), 1, 1000)
    return rows.where(~F.exists(inner, lambda p: p.isin(*skipped) | p.startswith(".")))


def line_range(df: DataFrame, text: str, offset: int, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines ``offset`` (from 1) to ``offset + limit - 1``."""
    return lines(df, text, keep).where(F.col("line_no").between(offset, offset + limit - 1))


def glob_regex(glob: str) -> str:
    """An anchored pattern: ** crosses folders, * and ? don't, {a,b} are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/ " else c
        i += 1
    return f"^{out}$"


def glob_files(df: DataFrame, glob: str, path: str = "path", limit: int = 100) -> DataFrame:
    return df.where(F.col(path).rlike(glob_regex(glob))).orderBy(path).limit(limit)


def sections(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(section_no, title, body) of the "## " sections; a heading glued to the line before gets its own line first."""
    repaired = F.regexp_replace(text, r"([^\r\n#])##(?!#)\s", "$1\n## ")
    parts = F.filter(F.split(F.concat(F.lit("\n"), repaired), r"\n## "), lambda p: p.isNotNull())
    rows = df.select(*keep, F.posexplode(parts).alias("section_no", "__s")).where("section_no > 0")
    first = F.substring_index("__s", "\n", 1)
    return rows.select(*keep, "section_no", F.trim(first).alias("title"), F.regexp_replace(F.expr("substring(__s, length(substring_index(__s, '\n', 1)) + 2)"), r"^\s+|\s+$", "").alias("body"))


#: Short names of priorities (fixed values).
PRIORITIES = {"p0": "lasting", "p1": "lasting", "p2": "standard", "p3": "ephemeral"}


def front_matter(text: Column) -> Column:
    """Map of the "key: value" lines between two "---" lines at the start; null without such a head."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda l: l.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    keys = F.transform(pairs, lambda l: F.lower(F.trim(F.substring_index(l, ":", 1))))
    values = F.transform(pairs, lambda l: F.regexp_replace(F.trim(F.regexp_replace(l, r"^[^:]*:", "")), r'^"(.*)"$', "$1"))
    first = F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int"))))
    return F.when((head != "") & (F.size(pairs) > 0), first)


def priority_of(value: Column) -> Column:
    low = F.lower(F.trim(value))
    for short, name in PRIORITIES.items():
        low = F.when(low == short, name).otherwise(low)
    return F.when(low.isin("lasting", "standard", "ephemeral"), low).otherwise("standard")


def separated(df: DataFrame, line: str, names: tuple[str, ...], separator: str = "\u0001") -> DataFrame:
    """Lines of at least len(names) fields as columns; the last takes what is left."""
    parts = F.split(line, separator, len(names))
    return df.where(F.size(parts) == len(names)).select(*[c for c in df.columns if c != line], *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def numstat(df: DataFrame, line: str = "line") -> DataFrame:
    """Sums of "added<TAB>removed<TAB>path" lines; "-" marks a binary file."""
    parts = F.split(line, "\t", 3)
    added, removed = F.get(parts, 0), F.get(parts, 1)
    rows = df.where(F.size(parts) == 3)
    return rows.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(added.try_cast("long")), F.lit(0)).alias("added"),
        F.coalesce(F.sum(removed.try_cast("long")), F.lit(0)).alias("removed"), F.count_if((added == "-") & (removed == "-")).alias("binary"),
    )


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def page_text(html: Column) -> Column:
    """A page's visible text: without scripts, styles and comments, tags as spaces, five references decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|head)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def link_cards(df: DataFrame, html: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(card_no, url, title) of the links of a page, in page order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), 0)
    rows = df.select(*keep, F.posexplode(found).alias("card_no", "__a"))
    return rows.select(*keep, "card_no", F.regexp_extract("__a", r'(?is)href="([^"]*)"', 1).alias("url"), F.trim(F.regexp_replace("__a", r"(?s)<[^>]*>", "")).alias("title"))


def paragraphs(df: DataFrame, text: str, keep: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(position, paragraph): parts between blank lines, without heading lines, of at least ``least`` characters."""
    parts = F.split(text, r"\r?\n\s*\r?\n")
    rows = df.select(*keep, F.posexplode(parts).alias("position", "__p"))
    plain = F.trim(F.regexp_replace("__p", r"(?m)^#{1,6}\s.*(?:\r?\n|$)", ""))
    return rows.withColumn("paragraph", plain).where(F.length("paragraph") >= least).drop("__p")


def notable_lines(df: DataFrame, text: str, key: str, words: tuple[str, ...], most: int = 40) -> DataFrame:
    """Of each text the last ``most`` distinct (lower-cased) lines that hold one of ``words``, with how many lines do."""
    from pyspark.sql import Window as W

    rows = lines(df, text, (key,)).withColumn("line", F.lower(F.trim("line"))).where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("line"), w)))
    once = rows.groupBy(key, "line").agg(F.max("line_no").alias("line_no"), F.count("*").alias("times"))
    w = W.partitionBy(key)
    return once.withColumn("__n", F.row_number().over(w.orderBy(F.desc("line_no")))).withColumn("total", F.sum("times").over(w)).where(F.col("__n") <= most).drop("__n")


def tail_lines(df: DataFrame, text: str, keep: tuple[str, ...], most_bytes: int) -> DataFrame:
    """Lines within the last ``most_bytes`` bytes (UTF-8); the first line, cut or not, is dropped, unless the tail has only that one."""
    data = F.encode(F.col(text), "UTF-8")
    size = F.octet_length(text)
    tail = F.substring(data, size - most_bytes + 1, F.lit(most_bytes))
    # A character that the cut splits goes; of a tail that is one line its remaining bytes go as well.
    hexed = F.regexp_replace(F.hex(tail), "^(?:[89AB][0-9A-F]){1,3}", "")
    tail = F.decode(F.unhex(hexed), "UTF-8")
    tail = F.when(size > most_bytes, F.regexp_replace(tail, r"^[^\n]*\n", "")).otherwise(F.col(text))
    return lines(df.withColumn("__t", tail), "__t", keep)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits over UTF-16 units, as eight hex digits (Arrow batches)."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_hashes(batch.tolist()), index=batch.index, dtype=object)

    return run(text)


def fnv1a_hashes(texts: list[str | None], most: int = 4_000_000) -> list[str | None]:
    """FNV-1a of each text. Texts are hashed side by side, longest first: step i takes unit i of all that have one. A few long texts are hashed one by one, and some ``most`` units are held at once."""
    out: list[str | None] = [None] * len(texts)
    units = {i: np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for i, t in enumerate(texts) if t is not None}
    order = sorted(units, key=lambda i: -len(units[i]))
    start = 0
    while start < len(order):
        longest = max(1, len(units[order[start]]))
        part = order[start : start + max(1, most // longest)]
        start += len(part)
        lengths = np.array([len(units[i]) for i in part])
        grid = np.zeros((longest, len(part)), dtype=np.uint32)
        for column, i in enumerate(part):
            grid[: lengths[column], column] = units[i]
        hashes = np.full(len(part), 0x811C9DC5, dtype=np.uint32)
        # Texts that have a unit at each step: a prefix, since lengths descend.
        having = np.searchsorted(-lengths, -np.arange(longest), side="left")
        step = 0
        while step < longest and having[step] > 8:
            n = having[step]
            hashes[:n] = (hashes[:n] ^ grid[step, :n]) * np.uint32(0x01000193)
            step += 1
        for column in range(having[step] if step < longest else 0):
            h = int(hashes[column])
            for u in grid[step : lengths[column], column].tolist():
                h = (h ^ u) * 0x01000193 & 0xFFFFFFFF
            hashes[column] = h
        for i, h in zip(part, hashes.tolist()):
            out[i] = f"{h:08x}"
    return out


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null if it is none (Arrow batches)."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        import json

        def one(t):
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return batch.map(one)

    return run(text)


def line_diff(before: Column, after: Column, exact: int = 100_000) -> Column:
    """Array of (op, line) with op " ", "-" or "+": a longest common subsequence where the two have up to ``exact`` pairs of lines, beyond that only the common head and tail (Arrow batches)."""

    @F.pandas_udf("array<struct<op:string,line:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_lines((x or "").split("\n") if x else [], (y or "").split("\n") if y else [], exact) for x, y in zip(a, b)])

    return run(before, after)


def diff_lines(a: list[str], b: list[str], exact: int) -> list[dict]:
    if len(a) * len(b) > exact:
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        same = lambda rows: [{"op": " ", "line": x} for x in rows]
        gone = [{"op": "-", "line": x} for x in a[head : len(a) - tail]]
        new = [{"op": "+", "line": x} for x in b[head : len(b) - tail]]
        return same(a[:head]) + gone + new + same(a[len(a) - tail :])
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append({"op": " ", "line": a[i]})
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and size[i + 1][j] >= size[i][j + 1]:
            out.append({"op": "-", "line": a[i]})
            i += 1
        else:
            out.append({"op": "+", "line": b[j]})
            j += 1
    return out


#: What separates words of a query, and words without a meaning of their own (fixed values).
DELIMITERS = r"[ \t\r\n,.!?;:()\[\]{}\"'/\\|，。！？、；：（）《》【】“”‘’…—]+"
STOPWORDS = (
    "帮我 帮忙 请你 麻烦 谢谢 感谢 顺便 一下 我们 你们 他们 她们 自己 大家 这个 那个 这样 那样 这些 那些 "
    "怎么 怎样 如何 为什么 多少 什么时候 可以 能不能 能否 是否 需要 想要 希望 给我 试试 看看 继续 开始 现在 刚才 "
    "还有 然后 但是 如果 因为 所以 以及 或者 而且 "
    "please help thanks thank hey hi hello me you he she it we they this that there here "
    "the a an to of and or for with in on at by how what why when where which who "
    "can could would should will is are was were do does did need want like also now just"
).split()


def query_variants(query: Column, most: int = 4) -> Column:
    """The words of a query worth searching for, as written, each once: no stopwords, two characters at least, not the query as a whole. Words with CJK characters lose stopwords at either end as long as two characters are left."""
    edges = "|".join(w for w in STOPWORDS if len(w) > 1)
    cut = lambda w: F.regexp_replace(F.regexp_replace(w, f"(?i)^(?:(?:{edges})(?=..))+", ""), f"(?i)(?<=..)(?:{edges})+$", "")
    words = F.transform(F.split(F.trim(query), DELIMITERS), lambda w: F.when(w.rlike("[\u4e00-\u9fff\u3400-\u4dbf]"), cut(w)).otherwise(w))
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), F.lower(w).alias("low")))
    # What a lambda refers to is worked out again for each element, unless it is a variable of another lambda: once bound, it is a value.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    kept = bound(F.lower(F.trim(query)), lambda whole: F.filter(pairs, lambda p: (F.length(p["word"]) >= 2) & ~p["low"].isin(*STOPWORDS) & (p["low"] != whole)))
    first = lambda k: F.transform(F.slice(F.array_distinct(k["low"]), 1, most), lambda low: F.get(k["word"], (F.array_position(k["low"], low) - 1).cast("int")))
    return bound(kept, first)


def word_tokens(text: Column) -> Column:
    """Lower-cased words, and pairs of neighbouring characters within runs of CJK."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[一-鿿]+|[a-z0-9]+"), 0)
    pairs = lambda r: F.when(r.rlike(r"^[一-鿿]{2,}$"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.array_distinct(F.flatten(F.transform(runs, pairs)))


def command_allowed(command: Column, deny: tuple[str, ...], allow: tuple[str, ...]) -> Column:
    """A command is refused if it holds a denied text; allowed if it as a whole and each of its segments begins with an allowed text."""
    refused = F.exists(F.array(*map(F.lit, deny)), lambda t: F.contains(command, t)) if deny else F.lit(False)
    fits = lambda c: F.exists(F.array(*map(F.lit, allow)), lambda t: F.startswith(F.trim(c), t)) if allow else F.lit(False)
    segments = F.filter(F.split(command, r"[;|&\n]+"), lambda s: F.trim(s) != "")
    return ~refused & fits(command) & F.forall(segments, fits)
