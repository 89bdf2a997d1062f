"""Exact BM25 top-k search over an inverted index with block-max WAND, shard by shard, merged under global statistics.

Terms are runs of letters, digits and underscores of the lower-cased text; a query is the set of its terms.

Index, built once and written to the shared folder: each task turns its documents into parts of SHARD documents at most, a row
each: ids, lengths, the sorted terms with the number of their postings, and the postings (document of the part, count). No
document is read again, however many queries follow.

Search: queries go to the tasks in broadcast blocks of bounded size, and a block is one pass over the index (its terms'
document frequencies are summed over the parts first, from the columns of terms alone). A task puts parts together to shards
of SHARD documents. Every list has a maximum, and one that stands in most documents a maximum for each block of WIDTH documents.
For a query, these long lists are ordered, and WAND's pivot is the list at which the maxima together reach the threshold, the
k-th best score the task has seen: no document can be a result by the lists before the pivot alone, so they rest. A document
found by the others is looked up in the resting lists only if its score so far and the maxima of its block in those lists reach
the threshold; all its other postings there are skipped. Of the others, the frequent ones are rows of a matrix in single
precision, which one product adds up for many queries (queries with the same most frequent term side by side), and the short ones
are walked posting by posting. Documents that may reach the threshold within the product's error are scored again in double
precision, so the results are exact. Each shard starts with the threshold that the task's earlier shards have raised, and the
first one takes its own from the documents with the highest bounds. The work still grows with queries times documents.
The tasks' best k of each query are merged. All weights come from global statistics, so the merge is exact.

Defined results
* documents without a term of the query are no results; empty, null and term-less queries have none.
* rows without an id take no part; of rows that share an id the best score counts; a query's own document is a result
  like any other; queries alike in id and text count once.
* ties (scores equal to 9 decimals) go to the smaller id; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quern.llm.shared import cut, shared_folder

K1, B = 1.2, 0.75
SHARD, WIDTH = 8192, 8
#: Queries and bytes of their texts in a block, about; documents in a task, about, and tasks at least.
BLOCK_QUERIES, QUERY_BYTES, TASK_DOCS, TASKS = 8192, 48 << 20, 20_000, 6
#: A list with a posting in every SPARSE documents is a row of a shard's matrix, DENSE lists at most; queries that are multiplied by it together, and that are walked together.
SPARSE, DENSE, TOGETHER, FEW = 16, 1024, 256, 8
_TERM = re.compile(r"\w+")
_SEP = "\u0000"
PART = "n long, tokens long, ids binary, lengths binary, words string, sizes binary, docs binary, counts binary"


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def _taken(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all elements of the slices start[i] : start[i] + size[i], one slice after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Block:
    """A block of queries: their ids, the vocabulary of their terms, and query i's terms as ``cols[at[i]:at[i + 1]]``."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        self.ids = ids
        found = [set(t.split(_SEP)) if t else set() for t in texts]
        self.words = sorted(set().union(*found)) if found else []
        number = {w: i for i, w in enumerate(self.words)}
        lists = [np.sort(np.fromiter((number[w] for w in f), dtype=np.int32, count=len(f))) for f in found]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.cols = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        self.idf, self.mean, self.shard, self.width = None, 1.0, SHARD, WIDTH
        self.order = np.arange(len(ids))

    def __getstate__(self):
        return {**self.__dict__, "words": _SEP.join(self.words)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = state["words"].split(_SEP) if state["words"] else []

    def weigh(self, df: np.ndarray, n: int, length: int) -> None:
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.mean = length / n if n and length else 1.0
        # Queries with the same most frequent term stand together, as they have many others in common.
        common = [int(c[df[c].argmax()]) if len(c) else -1 for c in (self.cols[a:b] for a, b in zip(self.at[:-1], self.at[1:]))]
        self.order = np.argsort(np.array(common, dtype=np.int64), kind="stable")


def index(docs: DataFrame, folder: str) -> DataFrame:
    """The inverted index of ``docs`` (id, text): a row for each part of a task's documents, written to ``folder``."""
    most = SHARD

    def part(ids: list[int], tokens: list[np.ndarray], vocabulary: dict[str, int]):
        words = sorted(vocabulary)
        rank = np.empty(len(words), dtype=np.int64)
        rank[[vocabulary[w] for w in words]] = np.arange(len(words))
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        # (term, document) as one number: sorted, equal neighbours are a posting's count.
        keys, counts = np.unique(rank[np.concatenate(tokens)] * most + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
        sizes = np.bincount(keys // most, minlength=len(words))
        arrays = [np.array(ids, dtype=np.int64), lengths, sizes.astype(np.int32), (keys % most).astype(np.int32), counts.astype(np.int32)]
        packed = [a.tobytes() for a in arrays]
        values = [len(ids), int(lengths.sum()), packed[0], packed[1], _SEP.join(words), *packed[2:]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in PART.split(", ")])

    def run(batches):
        ids, tokens, vocabulary, size = [], [], defaultdict(), 0
        vocabulary.default_factory = vocabulary.__len__  # a new term gets the next number
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                ids.append(i)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
                # A part ends at ``most`` documents, or earlier at so many terms that its lists stay small.
                if len(ids) >= most or size >= 4_000_000:
                    yield part(ids, tokens, vocabulary)
                    ids, tokens, size = [], [], 0
                    vocabulary.clear()
        if ids:
            yield part(ids, tokens, vocabulary)

    docs.mapInArrow(run, PART).write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(PART).parquet(folder)


class Best:
    """The best k scores and documents of each query, in order; -inf where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.scores, self.docs = np.full((queries, k), -np.inf), np.zeros((queries, k), dtype=np.int64)

    def of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        there = self.scores[query] > -np.inf
        return self.scores[query, there], self.docs[query, there]

    def put(self, queries: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        """Add results; of an id the best score counts, ties go to the smaller id."""
        k, rows = self.scores.shape[1], np.unique(queries)
        there = self.scores[rows] > -np.inf
        queries = np.concatenate([queries, np.repeat(rows, k).reshape(there.shape)[there]])
        scores, docs = np.concatenate([scores, self.scores[rows][there]]), np.concatenate([docs, self.docs[rows][there]])
        order = np.lexsort((-scores, docs, queries))
        once = np.ones(len(order), dtype=bool)
        once[1:] = (np.diff(queries[order]) != 0) | (np.diff(docs[order]) != 0)
        order = order[once]
        order = order[np.lexsort((docs[order], -scores[order], queries[order]))]
        queries, scores, docs = queries[order], scores[order], docs[order]
        rank = np.arange(len(queries)) - np.searchsorted(queries, queries)
        mine = rank < k
        self.scores[rows] = -np.inf
        self.scores[queries[mine], rank[mine]], self.docs[queries[mine], rank[mine]] = scores[mine], docs[mine]


class Shard:
    """The lists of one shard for a block's terms. ids, lengths: of its documents; terms, docs, counts: its postings, with the documents of each term ascending."""

    def __init__(self, block: Block, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, counts: np.ndarray):
        self.block, self.ids, n = block, ids, len(ids)
        order = np.argsort(terms, kind="stable")
        terms, self.docs, counts = terms[order], docs[order].astype(np.intp), counts[order]
        self.norm = K1 * (1 - B + B * lengths / block.mean)
        self.weight = block.idf[terms] * counts * (K1 + 1) / (counts + self.norm[self.docs])
        self.start = np.searchsorted(terms, np.arange(len(block.idf) + 1))
        size = np.diff(self.start)
        # Lists in most documents have a cell a document and their greatest weight in every block: they can rest. Other frequent lists
        # are rows of a matrix in single precision; what it finds is scored again. The rest are walked posting by posting.
        self.top = np.zeros(len(size))
        self.top[size > 0] = np.maximum.reduceat(self.weight, self.start[:-1][size > 0]) if len(terms) else 0.0
        width = block.width
        self.span = -(-n // width) * width
        self.long = (size * width > n) & (size * 2 > n)
        self.row = np.cumsum(self.long) - 1
        self.cells = np.zeros((int(self.long.sum()), self.span))
        inside = self.long[terms]
        self.cells[self.row[terms[inside]], self.docs[inside]] = self.weight[inside]
        self.tops = self.cells.reshape(len(self.cells), -(-n // width), width).max(axis=2, initial=0.0)
        often = np.sort(size[~self.long])[::-1][:DENSE]
        self.dense = ~self.long & (size * SPARSE > n) & (size >= often[-1] if len(often) == DENSE else True)
        self.line = np.cumsum(self.dense) - 1
        self.lines = np.zeros((int(self.dense.sum()), self.span), dtype=np.float32)
        inside = self.dense[terms]
        self.lines[self.line[terms[inside]], self.docs[inside]] = self.weight[inside]
        most = int(counts[inside].max(initial=0))
        self.counts = np.zeros(self.lines.shape, dtype=np.uint16 if most < 65536 else np.uint32)
        self.counts[self.line[terms[inside]], self.docs[inside]] = counts[inside]
        self.once = len(np.unique(ids)) == n
        #: Postings of the lists of all queries, and how many of them were read.
        self.posted = self.walked = 0

    def search(self, query: int, k: int, scores: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of ``scores`` and ``docs`` (the best so far) and of this shard."""
        best = Best(len(self.block.ids), k)
        best.scores[query, : len(scores)], best.docs[query, : len(docs)] = scores, docs
        self.search_all(np.array([query]), best)
        return best.of(query)

    def search_all(self, queries: np.ndarray, best: Best) -> None:
        """Put the results of several queries in this shard into ``best``. What neighbours have in common costs less."""
        block, n, k = self.block, len(self.ids), best.scores.shape[1]
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            count = block.at[some + 1] - block.at[some]
            cols, of = block.cols[_taken(block.at[some], count)], np.repeat(np.arange(len(some)), count)
            size = self.start[cols + 1] - self.start[cols]
            least = best.scores[some, k - 1]
            self.posted += int(size.sum())
            # The pivot: long lists are put first, those with the most postings for their maximum at the front; up to the pivot
            # all maxima together stay below the threshold, so no document can be a result by these lists alone.
            long = np.flatnonzero(self.long[cols])
            long = long[np.lexsort((self.top[cols[long]] / size[long], of[long]))]
            sums = np.concatenate([[0.0], np.cumsum(self.top[cols[long]])])
            before = sums[1:] - sums[np.searchsorted(of[long], of[long])] < np.where(least > -np.inf, least - 1e-8, np.inf)[of[long]]
            rests, walks = np.zeros((len(some), len(self.cells))), np.zeros((len(some), len(self.cells)))
            rests[of[long[before]], self.row[cols[long[before]]]] = 1.0
            walks[of[long[~before]], self.row[cols[long[~before]]]] = 1.0
            self.walked += int(size.sum() - size[long[before]].sum())
            tops = rests @ self.tops
            # Frequent lists: rows of the matrix, added up for all queries at once. Each sum has this relative error at most.
            dense = np.flatnonzero(self.dense[cols])
            used, place = np.unique(self.line[cols[dense]], return_inverse=True)
            if 2 * len(used) > len(self.lines):
                used, place = np.arange(len(self.lines)), self.line[cols[dense]]
            mine = np.zeros((len(some), len(used)), dtype=np.float32)
            mine[of[dense], place] = 1.0
            product = mine @ (self.lines if len(used) == len(self.lines) else self.lines[used])
            error = 3e-7 * (len(used) + 4)
            # Short lists are walked posting by posting.
            short = np.flatnonzero(~self.long[cols] & ~self.dense[cols] & (size > 0))
            ends = np.searchsorted(of[short], np.arange(len(some) + 1))
            found = []
            for first in range(0, len(some), FEW):
                few = slice(first, min(first + FEW, len(some)))
                lists = short[ends[few.start] : ends[few.stop]]
                take = _taken(self.start[cols[lists]], size[lists])
                to = self.docs[take]
                to += np.repeat((of[lists] - first) * self.span, size[lists])
                shape = (few.stop - first, self.span)
                sure = np.bincount(to, weights=self.weight[take], minlength=shape[0] * shape[1]).astype(np.float64, copy=False).reshape(shape)  # of nothing: whole numbers
                if walks[few].any():
                    sure += walks[few] @ self.cells
                about = sure + product[few]
                # Block maxima of the resting lists: a document is looked up in them only if with these it reaches the threshold.
                bound = about + np.repeat(tops[few], block.width, axis=1) if rests[few].any() else about
                if n > 4 * k and (least[few] == -np.inf).any():
                    least[few] = np.maximum(least[few], self._first_thresholds(about, bound, rests[few], k, error))
                hit = np.flatnonzero(bound >= np.maximum((least[few] - 1e-8) * (1 - error), 1e-300)[:, None])
                found.append((hit // self.span + first, hit % self.span, sure.ravel()[hit], about.ravel()[hit]))
            of_hit, doc, sure, about = (np.concatenate(x) for x in zip(*found))
            self.walked += int(rests.sum(axis=1)[of_hit].sum())
            rested = (rests[of_hit] * self.cells[:, doc].T).sum(axis=1)
            near = (about + rested) * (1 + error) >= least[of_hit] - 1e-8
            of_hit, doc, exact = of_hit[near], doc[near], (sure + rested)[near]
            # What is left gets the dense lists' weights in double precision.
            firsts = np.searchsorted(of[dense], np.arange(len(some) + 1))
            times = (firsts[1:] - firsts[:-1])[of_hit]
            term, there = cols[dense[_taken(firsts[of_hit], times)]], np.repeat(doc, times)
            held = self.counts[self.line[term], there].astype(np.float64)
            weight = block.idf[term] * held * (K1 + 1) / (held + self.norm[there])
            exact = np.round(exact + np.bincount(np.repeat(np.arange(len(doc)), times), weights=weight, minlength=len(doc)), 9)
            keep = (exact > 0) & (exact >= least[of_hit])
            best.put(some[of_hit[keep]], exact[keep], self.ids[doc[keep]])

    def _first_thresholds(self, about: np.ndarray, bound: np.ndarray, rests: np.ndarray, k: int, error: float) -> np.ndarray:
        """For each query a bound from below of its k-th score: of the documents with the highest bounds, if their ids differ."""
        some = np.argpartition(-bound[:, : len(self.ids)], 2 * k, axis=1)[:, : 2 * k]
        scores = (np.take_along_axis(about, some, axis=1) + np.einsum("qr,rqd->qd", rests, self.cells[:, some])) * (1 - error) - 1e-8
        if self.once:
            return np.partition(scores, -k, axis=1)[:, -k]
        out = np.full(len(some), -np.inf)
        for i, (ids, s) in enumerate(zip(self.ids[some].tolist(), scores.tolist())):
            most: dict[int, float] = {}
            for x, y in zip(ids, s):
                most[x] = max(y, most.get(x, -np.inf))
            if len(most) >= k:
                out[i] = sorted(most.values())[-k]
        return out


def _block_of(queries: DataFrame, blocks: int, number: int) -> Block:
    def run(batches):
        for batch in batches:
            packed = [_SEP.join(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.string())], names=["id", "terms"])

    mine = queries.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number)
    rows = mine.mapInArrow(run, "id long, terms string").orderBy("id", "terms").collect()
    return Block(np.array([r["id"] for r in rows], dtype=np.int64), [r["terms"] for r in rows])


def _numbers(words: str, get) -> np.ndarray:
    """The numbers of a part's terms in a block's vocabulary; -1 for terms that no query has."""
    return np.fromiter((get(w, -1) for w in words.split(_SEP)), dtype=np.int32) if words else np.zeros(0, np.int32)


def _frequencies(made: DataFrame, shared, words: int) -> np.ndarray:
    """The document frequency of each of a block's terms. Each task sends one sum a slice of the vocabulary."""
    slices = 16
    width = -(-max(1, words) // slices)

    def partial(batches):
        get = {w: i for i, w in enumerate(shared.value.words)}.get
        df = np.zeros(width * slices, dtype=np.int64)
        for batch in batches:
            for found, sizes in zip(batch.column(0), batch.column(1)):
                at = _numbers(found.as_py(), get)
                df[at[at >= 0]] += np.frombuffer(sizes.as_py(), dtype=np.int32)[at >= 0]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), pa.array([df[k * width : (k + 1) * width].tobytes() for k in range(slices)], pa.binary())], names=["slice", "df"])

    def total(group: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in group["df"])
        return pa.table({"slice": [group["slice"][0].as_py()], "df": pa.array([df.tobytes()], pa.binary())})

    rows = made.select("words", "sizes").mapInArrow(partial, "slice long, df binary").groupBy("slice").applyInArrow(total, "slice long, df binary").collect()
    df = np.zeros(width * slices, dtype=np.int64)
    for r in rows:
        df[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(bytes(r["df"]), dtype=np.int64)
    return df[:words]


def shards_of(batches, block: Block):
    """The shards of a task: its parts, put together until they hold SHARD documents."""
    get = {w: i for i, w in enumerate(block.words)}.get
    held, n = [], 0

    def joined():
        return Shard(block, *(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        for row in range(batch.num_rows):
            ids, lengths, words, sizes, docs, counts = (batch.column(c)[row].as_py() for c in range(2, 8))
            number = _numbers(words, get)
            numbers = np.repeat(number, np.frombuffer(sizes, np.int32))
            mine = numbers >= 0
            ids = np.frombuffer(ids, np.int64)
            held.append((ids, np.frombuffer(lengths, np.int64), numbers[mine], np.frombuffer(docs, np.int32)[mine] + n, np.frombuffer(counts, np.int32)[mine]))
            n += len(ids)
            if n >= block.shard:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _searched(made: DataFrame, shared, k: int) -> DataFrame:
    """(query, query_id, doc_id, score): each task's best k of each query."""

    def run(batches):
        block: Block = shared.value
        best = Best(len(block.ids), k)
        for shard in shards_of(batches, block):
            shard.search_all(block.order, best)
        for first in range(0, len(block.ids), 1000):
            at, place = np.nonzero(best.scores[first : first + 1000] > -np.inf)
            at += first
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(block.ids[at]), pa.array(best.docs[at, place]), pa.array(best.scores[at, place])], names=["query", "query_id", "doc_id", "score"])

    return made.mapInArrow(run, "query long, query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents for the text of each row of ``queries``."""
    spark = docs.sparkSession
    slim = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    asked = cut(slim(queries).where("text IS NOT NULL").distinct())
    made = index(slim(docs), f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    few = made.coalesce(max(TASKS, -(-total["n"] // TASK_DOCS)))  # whole tasks share a threshold
    shape = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-shape["n"] // BLOCK_QUERIES), -(-shape["b"] // QUERY_BYTES))
    out = None
    for number in range(blocks):
        block = _block_of(asked, blocks, number)
        block.weigh(_frequencies(made, spark.sparkContext.broadcast(block), len(block.words)), total["n"], total["tokens"])
        hits = _searched(few, spark.sparkContext.broadcast(block), k).withColumn("block", F.lit(number))
        out = hits if out is None else out.unionByName(hits)
    key = ["block", "query", "query_id"]
    best = out.groupBy(*key, "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op10_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 50 = 0"))


QUERIES = {"op10_bm25": op10_bm25}
