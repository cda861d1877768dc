"""Sinks: workbooks with overflow, Stata files, per-file texts, label tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.csv import write_csv
from termloom.sources.xlsx import MAX_CELL, MAX_ROWS, write_workbook


def cells(df: DataFrame) -> DataFrame:
    """Texts cut to what a cell holds."""
    return df.select(*[F.substring(c, 1, MAX_CELL).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def write_sheets(path: str, sheets: dict[str, DataFrame], most: int = MAX_ROWS) -> dict[str, str]:
    """One workbook; rows stream through the driver. A sheet of ``most`` rows or more, which do not fit, is also written whole as CSV.

    Returns the CSV files written, by sheet.
    """
    extra: dict[str, str] = {}
    folder = Path(path).with_name(f"{Path(path).stem}_csv")
    for name, df in sheets.items():
        if df.limit(most).count() >= most:
            extra[name] = str(folder / f"{name}.csv")
            write_csv(df, extra[name])
    write_workbook(path, {name: (df.columns, cells(df).toLocalIterator()) for name, df in sheets.items()})
    return extra


def stata_names(columns: list[str]) -> dict[str, str]:
    """Names that Stata takes; an error if two become the same."""
    out = {c: re.sub(r"\W", "_", c)[:32] for c in columns}
    if len(set(out.values())) < len(out):
        raise ValueError("column names collide when cut to 32 characters")
    return out


#: Cells of a panel that may come to the driver for a Stata file.
MOST_CELLS = 50_000_000
#: The file format of each Stata version.
STATA_FORMATS = {12: 114, 13: 117, 14: 118, 15: 118, 16: 118, 17: 118, 18: 118}


def write_stata(df: DataFrame, path: str, labels: dict[str, str] | None = None, version: int = 15) -> None:
    """A panel as .dta with labels of up to 80 characters, for a Stata version.

    The format is written by one process: a panel of more than MOST_CELLS cells is
    refused before any row is fetched, and goes to Parquet instead.
    """
    names = stata_names(df.columns)
    cells = df.count() * len(names)
    if cells > MOST_CELLS:
        raise ValueError(f"a panel of {cells:,} cells does not fit a Stata file written by the driver; write Parquet instead")
    if version not in STATA_FORMATS:
        raise ValueError(f"unknown Stata version: {version}")
    frame = df.toPandas().rename(columns=names)
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].fillna("")
    frame.to_stata(path, write_index=False, version=STATA_FORMATS[version], variable_labels={names[c]: v[:80] for c, v in (labels or {}).items() if c in names})


def read_stata(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A .dta file and its variable labels."""
    import pandas as pd

    with pd.io.stata.StataReader(path) as reader:
        labels = reader.variable_labels()
    frame = pd.read_stata(path)
    for c in frame.columns:
        if str(frame[c].dtype) == "category":
            frame[c] = frame[c].astype(str)
    return spark.createDataFrame(frame), labels


def label_table(spark: SparkSession, labels: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], "pos int, variable string, label string")


def write_texts(df: DataFrame, root: str) -> DataFrame:
    """Write each row's ``body`` to ``relative`` below a folder that all workers share; one file a row, put in place when whole.

    Lazy: gives the paths written. A task that runs again writes the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for rel, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = os.path.join(root, rel)
                os.makedirs(os.path.dirname(out), exist_ok=True)
                part = f"{out}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(body or "")
                os.replace(part, out)
                done.append(out)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return df.select("relative", "body").mapInArrow(run, "path string")
