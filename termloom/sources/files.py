"""Finding, fingerprinting and reading files."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.fields import stem_meta
from termloom.functions.text import lines

# What is read, and the encodings tried, in order.
EXTENSIONS = (".xlsx", ".xls", ".csv", ".txt")
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5", "utf-16", "utf-16le", "utf-16be")
TEXT_ENCODINGS = ENCODINGS[:5]
WHOLE_HASH = 200 << 20
SAMPLE_CHARS = 250_000
SAMPLE_WORDS = ("管理层讨论与分析", "经营情况讨论与分析", "年度报告", "目录", "公司代码")


def data_files(folders: Iterable[str], extensions: tuple[str, ...] = EXTENSIONS) -> tuple[list[str], dict[str, int], list[str]]:
    """Files below the folders, sorted in each; how many each folder has; errors met. Links are followed, no folder twice."""
    files: list[str] = []
    counts: dict[str, int] = {}
    errors: list[str] = []
    seen: set[str] = set()
    for folder in folders:
        for root, dirs, names in os.walk(folder, followlinks=True, onerror=lambda e: errors.append(str(e))):
            real = os.path.realpath(root)
            if real in seen:
                dirs.clear()
                continue
            seen.add(real)
            own = [n for n in sorted(names) if not n.startswith(("~$", ".")) and os.path.splitext(n)[1].lower() in extensions]
            files += [os.path.join(root, n) for n in own]
            if own:
                rel = os.path.relpath(root, folder)
                counts[os.path.basename(folder) + ("" if rel == "." else f"/{rel}")] = len(own)
    return files, counts, errors


def without_outputs(files: Iterable[str], output: str) -> list[str]:
    """Files other than the output, its hit files, and what lies in its checkpoint and CSV folders."""
    out = Path(output).resolve()
    own = {out, *(out.with_name(f"{out.stem}_{tail}") for tail in ("命中句子.xlsx", "命中句子.csv"))}
    folders = [out.with_name(f"{out.stem}_{tail}") for tail in ("checkpoint", "csv")]
    return [f for f in files if (p := Path(f).resolve()) not in own and not any(d in p.parents for d in folders)]


def binary(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files, read by Spark wherever they lie."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def manifest(files: DataFrame) -> DataFrame:
    """Size, time in UTC, hash method and SHA-256 of each file; large ones by their ends and size."""
    whole = F.col("length") <= WHOLE_HASH
    ends = F.concat(F.substring("content", 1, 1 << 20), F.substring("content", -(1 << 20), 1 << 20), F.col("length").cast("string").cast("binary"))
    return files.select(
        F.col("path").alias("输入文件"),
        F.col("length").alias("文件大小(字节)"),
        F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("修改时间(UTC)"),
        F.when(whole, "SHA256").otherwise("SHA256(首尾各1MB+文件大小)").alias("指纹算法"),
        F.when(whole, F.sha2("content", 256)).otherwise(F.sha2(ends, 256)).alias("文件指纹"),
    )


def first_that_decodes(raw: bytes, encodings: Iterable[str] = TEXT_ENCODINGS) -> tuple[str | None, str | None]:
    for e in encodings:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return None, None


def best_decoding(raw: bytes, encodings: Iterable[str] = ENCODINGS, prefer_utf8: bool = False, sample: int = SAMPLE_CHARS, words: tuple[str, ...] = SAMPLE_WORDS) -> tuple[str | None, str | None]:
    """The decoding with most Han characters and known words and fewest replacement marks; the first of equals."""
    if prefer_utf8:
        text, e = first_that_decodes(raw, ("utf-8", "utf-8-sig"))
        if e:
            return text, e
    found: list[tuple[int, str, str]] = []
    for e in encodings:
        try:
            text = raw.decode(e)
        except UnicodeDecodeError:
            continue
        head = text[:sample]
        han = sum("一" <= c <= "鿿" for c in head)
        found.append((han + 200 * sum(head.count(w) for w in words) - 20 * head.count("�"), text, e))
    if not found:
        return None, None
    best = max(range(len(found)), key=lambda i: (found[i][0], -i))
    return found[best][1], found[best][2]


def decoded(files: DataFrame, how: Callable[[bytes], tuple[str | None, str | None]] = first_that_decodes) -> DataFrame:
    """path, text, encoding of binary files; both null where nothing decodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [how(raw or b"") for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "text", "encoding"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string")


def lenient(c: Column) -> Column:
    """Bytes as UTF-8 without what is not valid in it; line ends to LF."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(c.cast("string")), F.lit("�"), F.lit("")), r"\r\n?", "\n")


def text_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each .txt: 公司代码, 年份 from its name (the year else from its folder), 文本内容."""
    found = decoded(binary(spark, path, "*.txt"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    meta = stem_meta(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))))
    year = F.when(meta["year"] != "", meta["year"]).otherwise(F.regexp_extract(folder, "((?:19|20)[0-9]{2})", 1))
    return found.select(meta["code"].alias("公司代码"), year.alias("年份"), lines(F.col("text")).alias("文本内容"), F.col("path").alias("__file"), F.lit(2).cast("long").alias("__row"))


def column_catalog(headers: Iterable[list[str]]) -> tuple[list[str], dict[str, int]]:
    """Columns by how many files have them, first seen first among equals."""
    n: Counter[str] = Counter()
    for h in headers:
        n.update(list(dict.fromkeys(h)))
    return [c for c, _ in n.most_common()], dict(n)


def read_header(path: str) -> list[str]:
    """The column names of one file, without reading its rows."""
    from termloom.sources.csv import csv_header
    from termloom.sources.xlsx import Workbook

    suffix = Path(path).suffix.lower()
    if suffix == ".xlsx":
        with Workbook(path) as book:
            return book.header()
    if suffix == ".csv":
        return csv_header(path)
    if suffix == ".txt":
        return ["公司代码", "年份", "文本内容"]
    raise ValueError(f"files of this kind need an optional reader: {path}")


def scan_columns(paths: list[str], progress: Callable[[int, int], None] | None = None) -> tuple[list[str], dict[str, int]]:
    headers = []
    for i, p in enumerate(paths, 1):
        try:
            headers.append(read_header(p))
        except (OSError, ValueError, KeyError):
            pass
        if progress:
            progress(i, len(paths))
    return column_catalog(headers)


def listed(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """Paths as a table, in their order."""
    return spark.createDataFrame([(i, f) for i, f in enumerate(files)], "pos long, path string")


def sampled(files: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` files by a hash of seed and path: the same ones in every run, whatever the order of the listing."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("path"))), "path").limit(n)


def batch(files: DataFrame, start: int = 0, limit: int = 0) -> DataFrame:
    """The sorted files from ``start`` on, ``limit`` of them (0: all)."""
    rows = files.orderBy("path").offset(start)
    return rows.limit(limit) if limit else rows


def pending(files: DataFrame, done: DataFrame | None) -> DataFrame:
    """The files that are not among those done."""
    return files if done is None else files.join(done.select("path").distinct(), "path", "left_anti")


def head(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, by file and row where they are known."""
    order = [c for c in ("__file", "__row") if c in records.columns]
    return (records.orderBy(*order) if order else records).limit(n)


def preview(records: DataFrame, n: int = 100, cell: int = 200) -> DataFrame:
    """The first ``n`` rows for a look: cells as texts cut to ``cell`` characters, blank where there is nothing."""
    return head(records, n).select(*[F.coalesce(F.substring(F.col(f"`{c}`").cast("string"), 1, cell), F.lit("")).alias(c) for c in records.columns])


def tally(rows: DataFrame, status: str, done: str) -> DataFrame:
    """How many rows have the status ``done``, and how many another or none."""
    ok = F.coalesce(F.col(status) == done, F.lit(False))
    return rows.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
