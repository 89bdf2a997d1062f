"""CSV grids of strings: commas or tabs, quotes, rows without any text dropped."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells): every cell a string. A record's separator is a tab if it holds one outside quotes before any comma, else a comma; one reader can't do that, so a file is parsed as a whole in an Arrow batch."""

    def parse(frames):
        for frame in frames:
            out = []
            for p, text in zip(frame["path"], frame["value"]):
                n = 0
                for record in _records(text):
                    cells = _cells(record)
                    if any(c.strip() for c in cells):
                        out.append((p, n, cells))
                        n += 1
            yield pd.DataFrame(out, columns=["path", "row_no", "cells"])

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInPandas(parse, "path string, row_no int, cells array<string>")


def _records(text: str):
    """Lines, joined while a quote is open."""
    held = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            yield held
            held = ""
    if held:
        yield held


def _cells(record: str) -> list[str]:
    tab, comma = record.find("\t"), record.find(",")
    separator = "\t" if tab >= 0 and (comma < 0 or tab < comma) else ","
    return next(csv.reader(io.StringIO(record), delimiter=separator), [])


def csv_line(cells: list) -> str:
    """A record with quotes only where needed; null as nothing."""
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
    return ",".join("" if c is None else quoted(str(c)) for c in cells)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", '"').option("escape", '"').option("header", "true").csv(path)
