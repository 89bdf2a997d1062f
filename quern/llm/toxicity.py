"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (3 to 5 characters, lower-cased, white space as one space) it holds, hashed to
2**BITS buckets. With p and q the smoothed numbers of toxic and other labelled texts that hold a bucket, and P and Q the
smoothed numbers of such texts, the bucket's value is its log ratio r = log(p/P) - log(q/Q); a logistic regression is fitted
on the scaled features, and the two factors are multiplied into one weight a bucket. Presence, not frequency, counts, so a
few toxic words weigh the same in a long text as in a short one. Scoring is a map over rows: whole texts, no shuffle.

Fitting takes at most ``sample`` labelled rows (those with the smallest hash of the id): all tasks join their rows with that
bounded list, and only the rows found are moved to the one task that fits. ``keep`` bounds the model's weights, ``least``
leaves out n-grams of fewer labelled texts; both are parameters of ``train``, and scoring knows no bound at all.

Defined results
* null and empty texts have no features and get the score of the intercept; other columns never enter a score.
* an id with several labels counts as toxic if one of them is; labels without a document or a value count for nothing.
  Of several texts under one labelled id the one with the smallest hash is learned from.
* without labels of both classes there is nothing to learn: every score is the share of toxic labels (0 without any).
* repeated rows are scored alike; empty tables give empty results; columns named like results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.linear import Rows, codes_of, gram_hashes, logistic, sigmoid

BITS, SIZES = 20, range(3, 6)
#: Labelled rows that a model is fitted on at most; weights that a model has at most; documents that a kept n-gram is in at least.
SAMPLE, KEEP, LEAST = 4_000, 60_000, 3
SMOOTH, L2, THRESHOLD = 0.5, 0.05, 0.3


def features(text: str | None) -> np.ndarray:
    found = list(gram_hashes(codes_of((text or "").lower()), SIZES, BITS))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Model:
    """Weights of buckets and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        self.buckets, self.weights, self.intercept = buckets, weights, intercept
        self.table = None

    def __getstate__(self):
        return self.buckets, self.weights, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << BITS, dtype=np.float32)
            self.table[self.buckets] = self.weights
            self.known = self.table != 0
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hits = [h[self.known[h]] for h in gram_hashes(codes_of((text or "").lower()), SIZES, BITS)]
            out[i] = self.intercept + (float(self.table[np.unique(np.concatenate(hits))].sum(dtype=float)) if hits else 0.0)
        return sigmoid(out)


def fit(texts: list[str | None], labels: np.ndarray, keep: int = KEEP, least: int = LEAST) -> Model:
    labels = np.asarray(labels, dtype=float)
    none = np.zeros(0, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.0
        return Model(none, np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    grams = [features(t) for t in texts]
    width = 1 << BITS

    def documents(chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen documents each bucket is."""
        out = np.zeros(width, dtype=np.int64)
        for k in range(0, len(chosen), 500):
            out += np.bincount(np.concatenate([grams[i] for i in chosen[k : k + 500].tolist()]), minlength=width)
        return out

    toxic = documents(np.flatnonzero(labels > 0))
    every = toxic + documents(np.flatnonzero(labels == 0))
    # Counts of documents, relative to the number of documents of the class.
    p = (toxic + SMOOTH) / (labels.sum() + 2 * SMOOTH)
    q = (every - toxic + SMOOTH) / (len(labels) - labels.sum() + 2 * SMOOTH)
    ratio = np.log(p / q)
    # The buckets that tell the classes apart most: log ratio times the root of the documents behind it.
    worth = np.where(every >= least, np.abs(ratio) * np.sqrt(every), 0)
    kept = np.sort(np.argpartition(-worth, min(keep, width - 1))[:keep])
    kept = kept[worth[kept] > 0]
    place = np.full(width, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    for i, g in enumerate(grams):
        cols = place[g]
        grams[i] = cols[cols >= 0]
    w, intercept = logistic(Rows(grams, len(kept), scale=ratio[kept]), labels, l2=L2 * len(labels) / 1000)
    return Model(kept, w * ratio[kept], intercept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep: int = KEEP, least: int = LEAST) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (id_col, label_col) that have a document."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    chosen = marks.join(texts.select("__id").distinct(), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # The sample's bound makes the broadcast small; one text an id is kept before anything moves to the fitting task.
    found = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("__label").alias("__label"))

    def run(frames):
        rows = pd.concat([pd.DataFrame({"__id": [], "__text": [], "__label": []}), *frames]).sort_values("__id", kind="stable")
        model = fit(rows["__text"].tolist(), rows["__label"].to_numpy(dtype=float), keep, least)
        yield pd.DataFrame({"bucket": [-1, *model.buckets.tolist()], "weight": [model.intercept, *model.weights.tolist()]})

    made = found.repartition(1).mapInPandas(run, "bucket int, weight double").toPandas()
    inner = made[made["bucket"] >= 0]
    return Model(inner["bucket"].to_numpy(np.int64), inner["weight"].to_numpy(float), float(made.loc[made["bucket"] < 0, "weight"].iloc[0]) if len(made) else -20.7)


def score_column(model: Model, text: Column) -> Column:
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(batch.tolist()))

    return run(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    return docs.withColumn(into, score_column(model, F.col(text_col)))


def held_out(id_: Column) -> Column:
    """Rows that the registered query never learns from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score(docs, train(docs, labels), into="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
