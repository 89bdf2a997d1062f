"""Helpers that several operators of this subpackage use: the shared folder, checkpoints and stable hashes."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MASK64 = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    kept = spark.sparkContext.getCheckpointDir()
    if kept:
        return kept
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quern-checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: reliable, so a lost executor costs nothing but a read."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, whatever file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Python workers get Arrow batches of ``size`` bytes instead of 10,000 rows of any length, for what runs meanwhile in this session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
