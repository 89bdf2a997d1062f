"""Ranked keyword search over notes: substring BM25, a LIKE fallback, recall over query variants."""

from __future__ import annotations

import re
import zlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quern.operators.index import SENT, GramIndex
from quern.operators.merge import union_first
from quern.operators.usage import in_closed_range
from quern.sources.sinks import checkpointed as _cut

MOST_TOKENS, SHORT = 8, 3
STATUSES = ("active", "warm")
K1, B = 1.2, 0.75
#: Equal parts asked for at most, and candidates for each signature beyond which one more is asked for.
MOST_ALIKE, DEAR = 3, 0.5


def tokens_of(query: str) -> list[str]:
    """Distinct words of a query, case folded, in order, MOST_TOKENS at most."""
    return list(dict.fromkeys(query.lower().split()))[:MOST_TOKENS]


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _hits(tokens: list[str]) -> Column:
    return _all([F.contains(F.lower("title"), F.lit(t)) | F.contains(F.lower("content"), F.lit(t)) for t in tokens])


def _counts(tokens: list[str]) -> list[Column]:
    """How often each token stands in title and content, overlaps included."""
    text = F.lower(F.concat_ws("\n\n\n", "title", "content"))
    return [F.regexp_count(text, F.lit(f"(?={re.escape(t)})")) for t in tokens]


def _length() -> Column:
    """The grams of title and content."""
    return F.coalesce(F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("content") - 2, F.lit(0)), F.lit(0))


def _bm25(tokens: list[str]) -> Column:
    """From __tf0, __tf1, ..., __len of a row and __n, __avg, __df0, __df1, ... of all."""
    score = F.lit(0.0)
    for i in range(len(tokens)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    return score


def by_rank(entries: DataFrame, tokens: list[str], statuses: tuple[str, ...] | None) -> DataFrame:
    """Entries that hold every token, scored by BM25 over three-character grams: a token is a phrase, its frequency the (overlapping) times it occurs, a length the grams of title and content. Statistics are over all entries, which are scanned; ``by_index`` needs no scan."""
    rows = entries.withColumns({f"__tf{i}": c for i, c in enumerate(_counts(tokens))}).withColumn("__len", _length())
    stats = rows.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(tokens))])
    joined = rows.where(_all([F.col(f"__tf{i}") > 0 for i in range(len(tokens))])).crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumn("score", _bm25(tokens)).withColumn("channel", F.lit("rank"))
    return _of(out, statuses).select(*entries.columns, "score", "channel")


def by_index(entries: DataFrame, tokens: list[str], statuses: tuple[str, ...] | None, index: GramIndex) -> DataFrame:
    """``by_rank`` from the lists of the tokens' grams in ``index``, which holds the same ``entries``; texts are read of rows that hold all grams of a token. Counts are taken, and written, while the result is built."""
    version = index.store.version()
    if not version.number or not version.numbers["entries"]:
        return entries.withColumn("score", F.lit(0.0)).withColumn("channel", F.lit("rank")).where("false")
    met = index.candidates(tokens, version)
    # The rarest grams bound how many there can be.
    met = F.broadcast(met) if index.longest_list(tokens, version) <= SENT else met
    held = lambda i: F.array_contains("__tokens", i)
    rows = entries.join(met.select(F.col("id").alias("__id"), F.col("tokens").alias("__tokens")), F.col("id") == F.col("__id"))
    tf = {f"__tf{i}": F.when(held(i), c).otherwise(0) for i, c in enumerate(_counts(tokens))}
    counted = _cut(rows.withColumns(tf).withColumn("__len", _length()).select("__id", *tf, "__len"))
    n, length = version.numbers["entries"], version.numbers["length"]
    stats = counted.agg(F.lit(n).alias("__n"), F.lit(length / n).alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(tokens))])
    scored = counted.where(_all([F.col(f"__tf{i}") > 0 for i in range(len(tokens))])).crossJoin(F.broadcast(stats))  # one row
    scored = scored.select("__id", _bm25(tokens).alias("score"))
    return _of(entries.join(scored, F.col("id") == F.col("__id")), statuses).select(*entries.columns, "score", F.lit("rank").alias("channel"))


def by_like(entries: DataFrame, tokens: list[str], statuses: tuple[str, ...] | None) -> DataFrame:
    """Entries that hold every token in title or content, two points for a title hit and one for a content hit. ASCII or not, case is folded on both sides."""
    points = reduce(lambda a, b: a + b, [F.when(F.contains(F.lower("title"), F.lit(t)), 2).otherwise(0) + F.when(F.contains(F.lower("content"), F.lit(t)), 1).otherwise(0) for t in tokens])
    return _of(entries.where(_hits(tokens)), statuses).withColumn("score", points.cast("double")).withColumn("channel", F.lit("like"))


def _of(df: DataFrame, statuses: tuple[str, ...] | None) -> DataFrame:
    return df.where(F.col("status").isin(*statuses)) if statuses else df


def search(
    entries: DataFrame,
    query: str,
    limit: int = 10,
    statuses: tuple[str, ...] | None = STATUSES,
    index: GramIndex | None = None,
    scope: str | None = None,
    start: int = 0,
    end: int = 0,
) -> DataFrame:
    """The best entries with score and channel (scores of the two channels can't be compared). Short tokens, or no hit by rank, fall back to LIKE.

    scope, start and end (of updated_at, both included, 0: open) select hits; the statistics of ranks are those of all entries.
    With ``index``, ranks are found by it, without a scan of all texts.
    """
    tokens = tokens_of(query)
    if not tokens or limit <= 0:
        return entries.withColumn("score", F.lit(0.0)).withColumn("channel", F.lit("")).where("false")

    def of(found: DataFrame) -> DataFrame:
        found = found.where(F.col("scope") == scope) if scope and scope.strip() else found
        return found.where(in_closed_range("updated_at", start, end)) if start > 0 or end > 0 else found

    like = of(by_like(entries, tokens, statuses))
    found = like
    if all(len(t) >= SHORT for t in tokens):
        rank = of(by_index(entries, tokens, statuses, index) if index else by_rank(entries, tokens, statuses))
        none = rank.limit(1).agg((F.count("*") == 0).alias("__none")).where("__none")
        # No row on the right side, and the left is never run.
        found = rank.unionByName(like.join(F.broadcast(none)).drop("__none"))
    return found.orderBy((F.col("status") != "active"), F.desc("score"), F.desc("updated_at"), "id").limit(max(1, min(50, limit)))


def recall(entries: DataFrame, queries: list[str], limit: int = 5, min_score: float = 0.0, scope: str | None = None, index: GramIndex | None = None) -> DataFrame:
    """Hits of several variants of a query, the first variant that finds an entry counts; warm entries at 0.8 of their score against ``min_score``, entries without a score pass. With ``scope``, all entries are searched only if the scope has no hit."""
    def of(scope: str | None) -> DataFrame:
        order = W.orderBy((F.col("status") != "active"), F.desc("score"), F.desc("updated_at"), "id")
        found = union_first([search(entries, q, limit, index=index, scope=scope).withColumn("rank", F.row_number().over(order)) for q in queries], ["id"], ["rank"])
        weighed = F.when(F.col("status") == "warm", F.col("score") * 0.8).otherwise(F.col("score"))
        return found.where(weighed.isNull() | (weighed >= min_score)).orderBy("query_no", "rank").limit(limit)

    if scope is None:
        return of(None)
    own = of(scope)
    none = own.limit(1).agg((F.count("*") == 0).alias("__none"))
    return own.unionByName(of(None).join(F.broadcast(none), F.col("__none")).drop("__none"))


def recall_reason(message: str, hits: int, kept: int, injected: int) -> str:
    """Why a recall gave what it gave."""
    if not message.strip():
        return "empty_message"
    if not hits:
        return "no_match"
    if not kept:
        return "filtered_by_threshold"
    return "already_injected" if not injected else "injected"


def render(rows: list, budget: int = 8000, most: int = 2000) -> str:
    """Entries as text, each up to ``most`` UTF-16 units, until the budget is used up (a short list on the driver)."""
    out, left = [], budget
    for r in rows:
        body = r["content"].encode("utf-16-le")[: most * 2].decode("utf-16-le", "ignore")
        text = f"- {r['title']}: {body}\n"
        units = len(text.encode("utf-16-le")) // 2
        if units > left:
            break
        out.append(text)
        left -= units
    return "".join(out)


def title_pairs(title: Column) -> Column:
    """The distinct pairs of neighbouring letters, digits and CJK characters of a title in lower case, sorted; a title of fewer than two has none, so it is like no other."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), "[^\u4e00-\u9fa5a-zA-Z0-9]", ""))
    pairs = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) >= 2, F.sort_array(F.array_distinct(pairs))).otherwise(F.array().cast("array<string>"))


def _groups(n: int, share: float) -> list[tuple[int, int, int]]:
    """(group, side, most differences) for a set of ``n``. Sizes are cut into ranges so wide that what is like a set (Jaccard ``share``) is in its own range or the next; a group is a range (side 0) or a range (1) and its next (2)."""
    most = lambda x, y: int((1 - share) / (1 + share) * (x + y) + 1e-9)
    low, before, k = 1, 0, 0
    while n > (high := max(low, int(low / share + 1e-9))):
        low, before, k = high + 1, high, k + 1
    after = int(high / share + 1e-9)
    found = [(2 * k, 0, most(high, high)), (2 * k + 1, 1, most(high, after))]
    if k:
        found.append((2 * k - 1, 2, most(before, int(before / share + 1e-9))))
    return [x for x in found if x[2]]


def signatures(sets: DataFrame, share: float, alike: int, groups: set[int] | None = None) -> DataFrame:
    """(mark, h, grp, side) of ``sets`` (g, h, pairs), for the ``groups`` of sizes (all if none are given).

    If two sets of a group differ in m elements at most, and all elements are dealt to m + ``alike`` parts by a hash, the sets are
    equal in ``alike`` of the parts or more. A mark tells g, the group, which parts, and what a set has in them, as one hash.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, marks, h, grp, side = batch.slice(at, 200), [np.zeros(0, dtype=np.int64)], [], [], []
                for g, name, items in zip(*(part.column(i).to_pylist() for i in range(3))):
                    hashes = np.array([zlib.crc32(x.encode()) for x in items], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    for group, which, most in _groups(len(items), share):
                        if groups is not None and group not in groups:
                            continue
                        parts = most + alike
                        # What a set has in a part, as the sum of its elements' hashes.
                        held = np.zeros(parts, dtype=np.uint64)
                        np.add.at(held, ((hashes >> np.uint64(33)) % np.uint64(parts)).astype(np.int64), hashes ^ (hashes >> np.uint64(29)))
                        held = (held + np.uint64(group)) * np.arange(1, 2 * parts, 2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                        held ^= held >> np.uint64(32)
                        combined = np.array(list(combinations(range(parts), alike)))
                        made = held[combined].sum(axis=1) + (combined @ (parts ** np.arange(alike))).astype(np.uint64) + np.uint64(zlib.crc32(g.encode()))
                        marks.append((made * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
                        h += [name] * len(made)
                        grp += [group] * len(made)
                        side += [which] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(h, pa.int64()), pa.array(grp, pa.int32()), pa.array(side, pa.int8())], names=["mark", "h", "grp", "side"])

    return sets.select("g", "h", "pairs").mapInArrow(run, "mark long, h long, grp int, side byte")


def similar_sets(sets: DataFrame, share: float) -> DataFrame:
    """(a, b), both ways, of the ``sets`` (g, s, pairs) of one g whose Jaccard overlap is ``share`` at least.

    Candidates share a signature (see ``signatures``). With one part that must be equal there are few signatures a set; where
    these meet too often (counted for each group of sizes, no pair is formed for that), two or three parts must be equal, which
    takes more signatures and leaves far fewer candidates. So candidates keep in proportion to the sets. Sets go by a 64-bit
    hash until they are verified; two of one hash are both verified against others, not against each other.
    """
    named = sets.withColumn("h", F.xxhash64("s"))
    found, groups = None, None
    for alike in range(1, MOST_ALIKE + 1):
        made = _cut(signatures(named, share, alike, groups))
        groups = set()
        if alike < MOST_ALIKE:
            n, left, right = F.count("*"), F.count_if(F.col("side") == 1), F.count_if(F.col("side") == 2)
            met = made.groupBy("mark", "grp").agg(n.alias("n"), (left * right + F.when(F.max("side") == 0, n * (n - 1) / 2).otherwise(0)).alias("met"))
            cost = met.groupBy("grp").agg((F.sum("met") > F.sum("n") * DEAR).alias("dear"))
            groups = {r["grp"] for r in cost.where("dear").collect()}  # ranges of title lengths
            made = made.where(~F.col("grp").isin(*groups)) if groups else made
        small = made.where("side < 2").select("mark", "side", F.col("h").alias("h1"))
        large = made.where("side <> 1").select("mark", F.col("side").alias("other"), F.col("h").alias("h2"))
        here = small.join(large, "mark").where("other - side = 1 AND h1 <> h2 OR side = 0 AND other = 0 AND h1 < h2").select("h1", "h2")
        found = here if found is None else found.unionByName(here)
        if not groups:
            break
    of = lambda i: named.select(F.col("h").alias(f"h{i}"), F.col("g").alias(f"g{i}"), F.col("s").alias(f"s{i}"), F.col("pairs").alias(f"pairs{i}"))
    near = found.distinct().join(of(1), "h1").join(of(2), "h2").where("g1 = g2 AND s1 <> s2")
    both = F.size(F.array_intersect("pairs1", "pairs2"))
    alike = near.where(both / (F.size("pairs1") + F.size("pairs2") - both) >= share).select(F.col("s1").alias("a"), F.col("s2").alias("b"))
    return alike.union(alike.select("b", "a"))


def query_tokens(query: str) -> list[str]:
    """Words of more than two characters in lower case; of words with CJK characters the whole and its pairs of neighbours."""
    found: list[str] = []
    for word in re.split(r"[\W_]+", query.lower()):
        if re.search("[\u4e00-\u9fa5]", word):
            found += [word, *(word[i : i + 2] for i in range(len(word) - 1))]
        elif len(word) > 2:
            found.append(word)
    return list(dict.fromkeys(found))


def shares_token(query: str, title: Column, snippet: Column) -> Column:
    """Whether title or snippet holds a token of the query; true for a query without tokens."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    tokens = query_tokens(query)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens]) if tokens else F.lit(True)


def near_duplicates(df: DataFrame, group: str | None, url: Column, title: str, order: str, share: float = 0.82, on_topic: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows that stay when, in order (a unique column), a row goes whose normalised URL is that of a row that stayed or whose title's character pairs overlap those of a kept row by ``share`` (Jaccard). Titles of fewer than two characters are like no other. Without ``group``, over all rows.

    Of the rows that stay, those not ``on_topic`` are deferred: their URLs count, but no title is compared with theirs. With
    ``limit``, a group's first rows in order are given, deferred ones only where others don't fill it.

    The result is that of the greedy scan, but worked out in rounds of joins: of the rows not yet decided, those first among
    all that their URL and kept titles are alike to stay, and what is alike to them goes. Equal titles are one set of pairs, so
    copies cost no pairs of rows; similar but unequal titles cost one row for each pair of sets. The rounds, as many as the
    longest chain of rows that decide on each other, run while the result is built.
    """
    g = F.col(group).cast("string") if group else F.lit("")
    topic = F.lit(True) if on_topic is None else F.coalesce(on_topic, F.lit(False))
    slim = df.select(F.col(order).alias("n"), F.coalesce(g, F.lit("")).alias("g"), url.alias("u"), title_pairs(F.col(title)).alias("pairs"), topic.alias("on"))
    name = F.sha2(F.to_json(F.struct("g", "pairs")), 256)
    slim = _cut(slim.withColumn("u", F.sha2(F.to_json(F.struct("g", "u")), 256)).withColumn("s", F.when(F.size("pairs") > 0, name)))
    sets = slim.where("s IS NOT NULL").groupBy("g", "s").agg(F.first("pairs").alias("pairs"))
    alike = _cut(similar_sets(sets, share))
    # Of equal URL and title only the first can stay: what takes it out takes out the others.
    first = F.min_by(F.struct("n", "on"), "n").alias("x")
    whole = slim.where("s IS NULL").select("n", "u", "s", "on").union(slim.where("s IS NOT NULL").groupBy("u", "s").agg(first).select("x.n", "u", "s", "x.on"))
    left, kept = _cut(whole), None

    def least(rows: DataFrame, into: str) -> DataFrame:
        """For each set, the first of ``rows`` on topic that has it or one alike."""
        own = rows.where("s IS NOT NULL AND on").groupBy("s").agg(F.min("n").alias("first"))
        near = alike.join(own.withColumnRenamed("s", "b"), "b").select(F.col("a").alias("s"), "first")
        return own.union(near).groupBy("s").agg(F.min("first").alias(into))

    while not left.isEmpty():
        by_url = left.groupBy("u").agg(F.min("n").alias("of_url"))
        here = left.join(by_url, "u").join(least(left, "of_set"), "s", "left")
        now = _cut(here.where((F.col("n") == F.col("of_url")) & (F.col("n") <= F.coalesce("of_set", "n"))).select("n", "u", "s", "on"))
        kept = now if kept is None else kept.union(now)
        rest = left.join(now.select("u").distinct(), "u", "left_anti").join(least(now, "gone_by"), "s", "left")
        left = _cut(rest.where(F.coalesce(F.col("n") < F.col("gone_by"), F.lit(True))).select("n", "u", "s", "on"))
    if kept is None:
        kept = left
    stay = df.join(kept.select(F.col("n").alias(order), (~F.col("on")).alias("__deferred")), order)
    if limit is not None:
        place = F.row_number().over(W.partitionBy(g if group else F.lit("")).orderBy("__deferred", order))
        stay = stay.withColumn("__place", place).where(F.col("__place") <= limit) if group else stay.orderBy("__deferred", order).limit(limit)
    return stay.select(*df.columns, *([] if on_topic is None else [F.col("__deferred").alias("deferred")]))
