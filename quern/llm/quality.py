"""Quality classifier by co-training two views of a document.

* The content view sees character trigrams (case kept, relative counts, hashed) and how often words recur.
* The metadata view sees a page's record and layout: language and source (hashed), length, lines, and the shares of
  upper-case letters, digits, other signs and spaces. It never sees words. The record holds language and source alone, so
  the layout's numbers are taken from the same text as the content view's: the two views are not independent of each other
  given the class, as the theory of co-training wants, only of different features.

Both start from the same labelled rows. In each round every unlabelled document is scored by both views (a map over rows), and
either view hands the ``handed`` documents it is surest about, in the ratio of the classes, to the other view as
pseudo-labels (a top-n over all documents); then both are fitted again. Labelled rows set aside from fitting calibrate each
view (Platt scaling) and weigh the two calibrated log-odds against each other. The combined score of every document is a map
over rows: whole texts, no shuffle.

Fitting takes at most ``labelled`` labelled rows (those with the smallest hash of the id) and 2 * ``rounds`` * ``handed``
pseudo-labels. All tasks join their rows with that bounded list, and only the rows found are moved to the fitting task.

Defined results
* null and empty texts: no trigrams, length 0; null language or source: a value of its own.
* an id with several labels has the lowest; labels without a document or value count for nothing. Of several texts under
  one labelled id the one with the smallest hash is learned from; unlabelled texts count each by its own hash, copies once.
* without labels of both classes (four rows of each) every score is the share of good labels (0.5 without any).
* repeated rows are scored alike; empty tables give empty results; a column named like the result is replaced; language
  and source columns that the table lacks count as null. Rows without an id are scored, but never learned from.
* ties in confidence go by the hash of the id, the id and the hash of the text.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.linear import Rows, codes_of, gram_hashes, logistic, sigmoid
from quern.llm.shared import cut

BITS, META_BITS = 16, 8
#: Labelled rows that a model is fitted on at most; co-training rounds; documents that a view hands over in a round at most.
LABELLED, ROUNDS, HANDED = 4_000, 3, 400
#: A view hands over what it calls good or bad with these probabilities at least and at most.
SURE, UNSURE = 0.95, 0.2
THRESHOLD = 0.5
META = ("lang", "source")
_WORDS, _NUMBERS = 1 << BITS, 3  # content: trigrams, then numbers
_KEYS, _LAYOUT = 1 << META_BITS, 9  # metadata: hashed keys, then numbers


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point up to U+FFFF: 1 upper case, 2 number, 3 punctuation or symbol, 4 space or control, else 0."""
    first = {"N": 2, "P": 3, "S": 3, "Z": 4, "C": 4}
    return np.array([1 if (c := unicodedata.category(chr(i))) in ("Lu", "Lt") else first.get(c[0], 0) for i in range(65536)], dtype=np.uint8)


def content(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the content view."""
    text = text or ""
    words = text.split()
    n = len(words)
    grams = next(gram_hashes(codes_of(text), range(3, 4), BITS), np.zeros(0, np.uint32))
    cols, counts = np.unique(grams, return_counts=True)
    vals = np.sqrt(counts / max(1, len(grams)))
    again = sum(map(eq, words, words[1:])) / max(1, n - 1)
    # Distinct words of stretches of 50: a measure that doesn't fall with the length of a text.
    stretches = [words[k : k + 50] for k in range(0, n, 50)]
    fresh = sum(len(set(s)) / len(s) for s in stretches) / len(stretches) if n else 1.0
    numbers = [again, 1 - fresh, min(len(text) / max(1, n), 40) / 40]
    return np.concatenate([cols.astype(np.int64), np.arange(_WORDS, _WORDS + _NUMBERS)]), np.concatenate([vals, numbers])


def metadata(text: str | None, keys: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of the metadata view; keys: the values of the metadata columns."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    share = np.bincount(_kinds()[np.minimum(codes, 65535)], minlength=5)[1:5] / max(1, len(codes))
    lines = text.split("\n")
    numbers = [*share.tolist(), np.log1p(len(codes)) / 10, np.log1p(len(lines)) / 10, np.log1p(max(map(len, lines))) / 10, np.log1p(len(codes) / len(lines)) / 10, len(set(lines)) / len(lines)]
    at = [zlib.crc32(f"{k}:{v}".encode()) % _KEYS for k, v in enumerate(keys)]
    return np.array([*at, *range(_KEYS, _KEYS + _LAYOUT)], dtype=np.int64), np.array([1.0] * len(at) + numbers)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log-odds."""
    w, b = logistic(Rows([np.zeros(1, np.int32)] * len(z), 1, [np.array([v]) for v in z]), y, l2=1e-3)
    return float(w[0]), b


class Model:
    """Two linear views, their calibration and the weights of their log-odds."""

    def __init__(self, views=(), calibration=(), mix=(0.0, 0.0), intercept: float = 0.0):
        self.views, self.calibration, self.mix, self.intercept = views, calibration, mix, intercept

    def log_odds(self, view: int, found: tuple[np.ndarray, np.ndarray]) -> float:
        (w, b), (slope, shift) = self.views[view], self.calibration[view]
        cols, vals = found
        return slope * (float(w[cols] @ vals) + b) + shift

    def both(self, texts: list, keys: list[tuple]) -> np.ndarray:
        """The calibrated log-odds of either view, a column each."""
        return np.array([(self.log_odds(0, content(t)), self.log_odds(1, metadata(t, k))) for t, k in zip(texts, keys)], dtype=float).reshape(-1, 2)

    def scores(self, texts: list, keys: list[tuple]) -> np.ndarray:
        if not self.views:
            return sigmoid(np.full(len(texts), self.intercept))
        return sigmoid(self.intercept + self.both(texts, keys) @ np.asarray(self.mix))

    def packed(self) -> bytes:
        return pickle.dumps((self.views, self.calibration, self.mix, self.intercept))


def fit(texts: list, keys: list[tuple], labels: np.ndarray, taught: np.ndarray | None = None) -> Model:
    """Both views, fitted once. labels: 1 good, 0 bad; taught: the view that alone learns from the row, -1 for labelled rows."""
    labels = np.asarray(labels, dtype=float)
    taught = np.full(len(labels), -1) if taught is None else np.asarray(taught)
    known = np.flatnonzero(taught < 0)
    good = labels[known].mean() if len(known) else 0.5
    if good in (0.0, 1.0) or min(labels[known].sum(), (1 - labels[known]).sum()) < 4:
        return Model(intercept=float(np.log(max(good, 1e-6) / max(1 - good, 1e-6))))
    # Every fourth labelled row of each class is for calibration.
    aside = np.concatenate([known[labels[known] == y][::4] for y in (0, 1)])
    base = np.setdiff1d(known, aside)
    widths = (_WORDS + _NUMBERS, _KEYS + _LAYOUT)
    views, calibration, odds = [], [], []
    for view in (0, 1):

        def sparse(rows: np.ndarray) -> Rows:
            some = [content(texts[i]) if view == 0 else metadata(texts[i], keys[i]) for i in rows.tolist()]
            return Rows([c for c, _ in some], widths[view], [v for _, v in some])

        learned = np.concatenate([base, np.flatnonzero(taught == view)])
        w, b = logistic(sparse(learned), labels[learned], l2=0.05)
        raw = sparse(aside).times(w) + b
        slope, shift = _platt(raw, labels[aside])
        views.append((w.astype(np.float32), b))
        calibration.append((slope, shift))
        odds.append(slope * raw + shift)
    mix, intercept = logistic(Rows([np.arange(2)] * len(aside), 2, list(np.stack(odds, axis=1))), labels[aside], l2=0.05)
    return Model(views, calibration, tuple(mix.tolist()), intercept)


def _keys(frame: pd.DataFrame, n: int) -> list[tuple]:
    return [tuple(None if pd.isna(v) else v for v in row) for row in zip(*(frame[f"__k{i}"] for i in range(n)))] if n else [()] * len(frame)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols=META, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> Model:
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("__label"))
    names = [f"__k{i}" for i in range(len(meta_cols))]
    keys = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(k) for c, k in zip(meta_cols, names)]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *keys).where("__id IS NOT NULL").withColumn("__mark", F.xxhash64("__text"))
    hashed = F.xxhash64("__id")
    known = cut(marks.join(rows.select("__id").distinct(), "__id", "left_semi").orderBy(hashed, "__id").limit(labelled))
    kind = rows.schema["__id"].dataType.simpleString()
    given = spark.createDataFrame([], f"__id {kind}, __mark long, __label double, __taught int")
    shares = known.agg(F.avg("__label").alias("good")).first()["good"]

    def fitted(given: DataFrame) -> Model:
        """Both views on the labelled rows and the pseudo-labels ``given``; both tables are bounded."""
        first = F.min_by(F.struct("__text", *names), F.struct("__mark", *names)).alias("row")
        own = rows.join(F.broadcast(known), "__id").groupBy("__id").agg(first, F.first("__label").alias("__label")).select("__id", F.lit(None).cast("long").alias("__mark"), "row", "__label", F.lit(-1).alias("__taught"))
        lent = rows.join(F.broadcast(given), ["__id", "__mark"]).groupBy("__id", "__mark", "__taught").agg(first, F.first("__label").alias("__label")).select("__id", "__mark", "row", "__label", "__taught")
        sample = own.unionByName(lent).select("__id", "__mark", "row.*", "__label", "__taught")

        def run(frames):
            frame = pd.concat([pd.DataFrame({c: [] for c in ["__id", "__mark", "__text", *names, "__label", "__taught"]}), *frames]).sort_values(["__taught", "__id", "__mark"], kind="stable")
            made = fit(frame["__text"].tolist(), _keys(frame, len(names)), frame["__label"].to_numpy(dtype=float), frame["__taught"].to_numpy(dtype=int))
            yield pd.DataFrame({"model": [made.packed()]})

        found = sample.repartition(1).mapInPandas(run, "model binary").first()
        return Model(*pickle.loads(bytes(found["model"]))) if found else Model()

    model, lent = fitted(given), []
    for _ in range(rounds if model.views else 0):
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("z0 double, z1 double")
        def odds(text: pd.Series, keys: pd.DataFrame) -> pd.DataFrame:
            keys.columns = [f"__k{i}" for i in range(keys.shape[1])]
            return pd.DataFrame(shared.value.both(text.tolist(), _keys(keys, keys.shape[1])), columns=["z0", "z1"])

        scored = rows.select("__id", "__mark", odds(F.col("__text"), F.struct(*(F.col(k) for k in names)) if names else F.struct(F.lit(None).cast("string").alias("none"))).alias("z")).select("__id", "__mark", "z.*")
        free = cut(scored.join(marks.select("__id"), "__id", "left_anti").groupBy("__id", "__mark").agg(F.min("z0").alias("z0"), F.min("z1").alias("z1")))
        new = []
        for view in (0, 1):
            taken = {(i, m) for i, m, _, v in lent if v == 1 - view}
            for label, n, sure in ((1.0, max(1, round(handed * shares)), F.col(f"z{view}") >= float(np.log(SURE / (1 - SURE)))), (0.0, max(1, round(handed * (1 - shares))), F.col(f"z{view}") <= float(np.log(UNSURE / (1 - UNSURE))))):
                order = F.desc(f"z{view}") if label else F.asc(f"z{view}")
                # As many as may have been handed over before are looked at besides.
                best = free.where(sure).orderBy(order, hashed, "__id", "__mark").limit(n + len(taken)).select("__id", "__mark").collect()
                new += [(i, m, label, 1 - view) for i, m in [tuple(r) for r in best if tuple(r) not in taken][:n]]
        if not new:
            break
        lent += new
        model = fitted(spark.createDataFrame(lent, given.schema))
    return model


def score_column(docs: DataFrame, model: Model, text_col: str = "text", meta_cols=META) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series, keys: pd.DataFrame) -> pd.Series:
        keys.columns = [f"__k{i}" for i in range(keys.shape[1])]
        return pd.Series(shared.value.scores(text.tolist(), _keys(keys, keys.shape[1])))

    keys = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"k{i}") for i, c in enumerate(meta_cols)]
    return run(F.col(text_col), F.struct(*keys))


def score(docs: DataFrame, model: Model, text_col: str = "text", meta_cols=META, into: str = "quality_score") -> DataFrame:
    """``docs`` with the probability that a document is good."""
    return docs.withColumn(into, score_column(docs, model, text_col, meta_cols))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *META)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, into="score").select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
