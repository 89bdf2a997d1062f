"""Session factory and the few settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI SQL and adaptive execution on.

    ``master`` is left to spark-submit unless given. Further settings go in ``conf`` with ``__`` for dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.sql.shuffle.partitions", os.environ.get("QUERN_SHUFFLE", "8"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
