"""Corpus cleaning pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns rows with the columns of
documents; the last returns the digest of the encoded documents. Every stage's result is written as Parquet and read again
as the next one's input, so a lost executor repeats one stage's tasks at most. A stage's result goes once the next is written.

Defined results, of every stage but the last: an empty table stays empty; columns beside those of documents are kept, whatever
their names; rows without an id are judged like others. Null and empty texts are scored by the intercepts, are near-duplicates
of each other, and are never mixed in, as they hold no word. Repeated rows are judged alike, one of them is left by the
near-duplicate stage, and ties there and in mixing go by the smaller id or hash, so a rerun keeps the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import bpe, mixing, quality, simhash, toxicity
from quern.llm.shared import drop_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model, F.col("text")) < toxicity.THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two views together call good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(docs, model) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of each document's token ids and of what they decode to."""
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifiers, components and merges have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.mode("overwrite").parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
        if number:
            drop_folder(spark, f"{folder}/{number - 1}")
    return docs
