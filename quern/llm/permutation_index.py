"""Approximate nearest neighbours by inner product with a permutation index.

Fitting: PIVOTS vectors serve as pivots: of the POOL distinct vectors with the smallest hash of the id, each the one whose
direction is farthest from those taken before, so that neither copies nor near copies of one vector fill the places (pivots
alike move as one block in every order and drown the rest). A vector is represented by the order of its POSTED nearest
pivots and posted, with the pivot's place in that order, in the inverted file of each of them.

Search: a query orders the pivots and walks the files of its WALKED nearest ones only. Every posting met lowers the footrule
distance (the sum of |place in the query's order - place in the vector's order|; a pivot that a vector isn't posted under
counts with the mean of the places left over), so vectors are ranked by what the walk finds. The RERANK share of the shard
with the smallest distance, DEPTH for each neighbour wanted at least (ties to the smaller id), is scored exactly, and the
best k of all shards are merged. So that nearness follows the inner product for vectors of any length, orders are taken after
each vector is lifted to the largest norm by one more component.

Scale: vectors are dealt to shards of some SHARD rows by a hash, once; a shard's inverted files are written to the shared
folder as one row. Queries go to the tasks in broadcast blocks of some BLOCK rows, and a block is one pass over the files; a
task keeps the best k of each query over all its shards. So neither the vectors nor the queries are multiplied in a shuffle.
Of equal vectors the k + 1 with the smallest ids are indexed, as no other can be among a query's k nearest; this limit is
applied before the shuffle, so a very common vector fills no task.

Defined results
* vectors that are null, empty or zero, hold null or non-finite components, or differ from the most common dimension (no
  inner product with most others) take no part, neither as queries nor as candidates; rows without an id take no part.
* rows alike in id and vector count once; rows with the query's id are its own and no candidates. Of different vectors under
  one id the nearest counts as the candidate, and each as a query of its own.
* ties in the score go to the smaller id; fewer candidates than k: all of them. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quern.llm.shared import cut

PIVOTS, POSTED, WALKED, RERANK, DEPTH = 256, 64, 32, 0.16, 20
SHARD, BLOCK = 8192, 16_384
#: Shards that a task works on in turn, about, and tasks at least.
PER_TASK, TASKS = 8, 32
POOL = 16 * PIVOTS


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers and one isn't zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def far_apart(pool: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows in order of choice: the first, then always the one with the smallest largest cosine to those chosen."""
    unit = pool / np.abs(pool).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    chosen, nearest_one = [0], unit @ unit[0]
    nearest_one[0] = np.inf
    while len(chosen) < min(most, len(pool)):
        i = int(np.argmin(nearest_one))
        chosen.append(i)
        nearest_one = np.maximum(nearest_one, unit @ unit[i])
        nearest_one[i] = np.inf
    return pool[chosen]


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, top: float, most: int) -> np.ndarray:
    """The ``most`` nearest pivots of each vector in order, vectors and pivots lifted to the squared norm ``top``."""
    lift = lambda v: np.sqrt(np.maximum(top - np.einsum("ij,ij->i", v, v), 0.0))
    return np.argsort(-(vectors @ pivots.T + np.outer(lift(vectors), lift(pivots))), axis=1, kind="stable")[:, :most]


class InvertedFiles:
    """The inverted files of one shard. ids ascend, vectors in rows; the file of pivot p is rows[starts[p] : starts[p + 1]], with their places."""

    def __init__(self, ids, vectors, starts, rows, places):
        self.ids, self.vectors, self.starts, self.rows, self.places = ids, vectors, starts, rows, places

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, top: float, posted: int = POSTED) -> "InvertedFiles":
        orders = pivot_orders(vectors.astype(np.float64), pivots, top, posted)
        n, posted = orders.shape
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        starts = np.searchsorted(orders.ravel()[by_pivot], np.arange(len(pivots) + 1))
        return cls(ids, vectors, starts, (by_pivot // posted).astype(np.int32), (by_pivot % posted).astype(np.uint8))

    def search(self, queries: np.ndarray, orders: np.ndarray, own: np.ndarray, k: int, posted: int = POSTED, rerank: float = RERANK, depth: int = DEPTH):
        """For each query (rows, with its pivots in order and the id that is its own): ids and scores of its k nearest found."""
        n, missing = len(self.ids), (posted + len(self.starts) - 1) // 2
        wanted = min(n, max(depth * k, k + 1, int(np.ceil(rerank * n))))
        once = len(np.unique(self.ids)) == n
        for q, order, mine in zip(queries, orders, own.tolist()):
            # The postings of the walked files, one file after the other.
            sizes = self.starts[order + 1] - self.starts[order]
            take = np.repeat(self.starts[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            at = np.repeat(np.arange(len(order)), sizes)
            nearer = np.bincount(self.rows[take], weights=missing - at - np.abs(at - self.places[take]), minlength=n)
            near = np.argpartition(np.arange(n) - nearer.astype(np.int64) * n, wanted - 1)[:wanted]
            near = near[self.ids[near] != mine]
            scores = self.vectors[near].astype(np.float64) @ q
            ids = self.ids[near]
            best = np.lexsort((ids, -scores))
            if not once:  # of an id its best
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            best = best[:k]
            yield ids[best], scores[best]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of two lists (ids, scores), an id once."""
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((ids, -scores))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
    return ids[order], scores[order]


def index(vectors: DataFrame, pivots: np.ndarray, top: float, dim: int, shards: int, posted: int = POSTED) -> DataFrame:
    """The inverted files of all shards, a row each; ``vectors``: (id, v). Each shard is one task."""
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches):
        held = [(b.column(0).to_numpy(), _matrix(b.column(1), dim)) for b in batches if b.num_rows]
        if held:
            ids, rows = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            made = InvertedFiles.build(ids[order], rows[order], pivots, top, posted)
            parts = (made.ids.astype("<i8"), made.vectors.astype(kind), made.starts.astype("<i8"), made.rows.astype("<i4"), made.places)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "vectors", "starts", "files", "places"])

    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    return vectors.repartitionById(shards, shard).sortWithinPartitions("id", "v").mapInArrow(run, "ids binary, vectors binary, starts binary, files binary, places binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: float = RERANK, walked: int = WALKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found among ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    slim = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    every = cut(slim(vectors))
    shape = every.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(_square(F.col("v"))).alias("top")).orderBy(F.desc("n"), "dim").first()
    asked = cut(slim(queries).where(F.size("v") == (shape["dim"] if shape else 0)))
    count = asked.count()
    if shape is None or not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = shape["dim"], shape["n"]
    kind = "<f4" if every.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    every = every.where(F.size("v") == dim)
    distinct = every.groupBy("v").agg(F.min(F.struct(F.xxhash64("id").alias("hash"), "id")).alias("first"))
    pivots = far_apart(_matrix(distinct.orderBy("first").limit(POOL).select("v").toArrow()["v"], dim), PIVOTS)
    top = max(shape["top"], float(np.einsum("ij,ij->i", pivots, pivots).max()))
    shards = -(-n // SHARD)

    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = every.withColumn("nth", first).where(F.col("nth") <= k + 1).drop("nth")
    files = cut(index(few, pivots, top, dim, shards))
    if shards > TASKS:
        files = files.coalesce(max(TASKS, -(-shards // PER_TASK)))
    blocks = -(-count // BLOCK)
    out = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(blocks)) == number).orderBy("id", "v").toArrow()
        shared = spark.sparkContext.broadcast((mine["id"].to_numpy(), _matrix(mine["v"], dim) if mine.num_rows else np.zeros((0, dim)), pivots))

        def run(batches, shared=shared):
            own, asks, pivots = shared.value
            posted = min(POSTED, len(pivots))
            # A query has nothing in the added component, so its products with lifted vectors are those with the vectors.
            orders = np.argsort(-(asks @ pivots.T), axis=1, kind="stable")[:, :walked]
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, rows, starts, files, places = (batch.column(c)[i].as_py() for c in range(5))
                    shard = InvertedFiles(np.frombuffer(ids, "<i8"), np.frombuffer(rows, kind).reshape(-1, dim), np.frombuffer(starts, "<i8"), np.frombuffer(files, "<i4"), np.frombuffer(places, np.uint8))
                    for q, found in enumerate(shard.search(asks, orders, own, k, posted, rerank)):
                        best[q] = _merged(best[q], found, k)
            for start in range(0, len(best), 1000):
                some = best[start : start + 1000]
                at = np.repeat(np.arange(start, start + len(some)), [len(a) for a, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at]), pa.array(np.concatenate([a for a, _ in some])), pa.array(np.concatenate([s for _, s in some]))], names=["query", "query_id", "vec_id", "score"])

        hits = files.mapInArrow(run, "query long, query_id long, vec_id long, score double").withColumn("block", F.lit(number))
        out = hits if out is None else out.unionByName(hits)
    key = ["block", "query", "query_id"]
    best = out.groupBy(*key, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op2_permutation_index": op2_permutation_index}
