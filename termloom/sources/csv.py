"""Delimited text: encoding and delimiter are probed on the head, Spark reads the rest."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.files import ENCODINGS
from termloom.sources.layout import column_names

HEAD = 64 << 10
# Cell texts that stand for nothing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def probe(path: str) -> tuple[str, str]:
    """Encoding and delimiter of a local file."""
    with open(path, "rb") as f:
        raw = f.read(4 * HEAD)
        whole = len(raw) < 4 * HEAD
    for encoding in ENCODINGS:
        try:
            decoder = io.TextIOWrapper(io.BytesIO(raw), encoding=encoding, newline="")
            head = decoder.read(HEAD)
        except UnicodeDecodeError as e:
            if whole or e.end < len(raw) - 8:
                continue
            head = raw.decode(encoding, "ignore")[:HEAD]
        try:
            return encoding, csv.Sniffer().sniff(head, delimiters=",\t;|").delimiter
        except csv.Error:
            return encoding, ","
    raise ValueError(f"unknown encoding: {path}")


def csv_header(path: str, found: tuple[str, str] | None = None) -> list[str]:
    encoding, delimiter = found or probe(path)
    with open(path, encoding="utf-8-sig" if encoding == "utf-8" else encoding, newline="") as f:
        return column_names(next(csv.reader(f, delimiter=delimiter), []))


#: Encodings whose characters of several bytes never hold a quote, a comma, a tab or a line end: split as single bytes, decoded after.
BYTEWISE = ("gb18030", "gbk", "big5")


def _decoded(df: DataFrame, names: list[str], encoding: str) -> DataFrame:
    """The texts of columns read as single bytes, in their real encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pa.array([None if t is None else t.encode("latin-1").decode(encoding, "replace") for t in b.column(i).to_pylist()], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *b.columns[len(names) :]], b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema))


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """All columns as texts, cells that stand for nothing as null, with __file and __row (2 for the first row).

    Files of a list share the first one's header, encoding and delimiter. A file
    is read in splits unless a quoted cell goes over a line end, which a scan of
    the lines finds out. Row numbers are the place in a split and the rows of the
    splits before it, counted once.
    """
    paths = [path] if isinstance(path, str) else path
    if encoding is None or delimiter is None:
        encoding, delimiter = probe(paths[0])
    names = csv_header(paths[0], (encoding, delimiter))
    bytewise = encoding in BYTEWISE and delimiter != "|"
    charset = "ISO-8859-1" if bytewise else {"utf-8-sig": "UTF-8", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}.get(encoding, encoding.upper())
    wide = not bytewise and not encoding.startswith("utf-8")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    whole = wide or not spark.read.text(paths).filter(quotes % 2 == 1).isEmpty()
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    df = spark.read.csv(paths, schema=schema, header=True, sep=delimiter, encoding=charset, multiLine=whole, quote='"', escape='"', enforceSchema=True)
    file = F.when(F.lit(len(paths) == 1), F.lit(paths[0])).otherwise(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")))
    at = F.monotonically_increasing_id()
    df = df.select(*[F.col(f"`{n}`") for n in names], file.alias("__file"), F.shiftright(at, 33).cast("int").alias("__split"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))
    counts = df.groupBy("__split", "__file").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first")).orderBy("__split", "first").collect()  # a row a split and file
    starts: dict[str, int] = {}
    shifts = []
    for r in counts:
        shifts.append((r["__split"], r["__file"], starts.get(r["__file"], 0) - r["first"] + 2))
        starts[r["__file"]] = starts.get(r["__file"], 0) + r.n
    shift = F.broadcast(spark.createDataFrame(shifts, "__split int, __file string, __shift long"))
    df = df.join(shift, ["__split", "__file"]).withColumn("__row", F.col("__row") + F.col("__shift")).select(*[F.col(f"`{n}`") for n in names], "__file", "__row")
    df = _decoded(df, names, encoding) if bytewise else df
    return df.select(*[F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")).alias(n) for n in names], "__file", "__row")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a byte order mark, from a sorted result; rows come to the driver one partition at a time."""
    import os
    import tempfile

    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8-sig", newline="", dir=folder, delete=False) as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for row in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in row])
    os.replace(f.name, path)
