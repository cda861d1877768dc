"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python step works on at a time.
CHUNK_BYTES = 2 << 20


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names based on ``wanted`` that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def distributed_rank(df: DataFrame, part: Sequence[str], bucket: Sequence[str], order: Sequence[Column], out: str, like: DataFrame | None = None) -> DataFrame:
    """Gapless ranks from 1 within ``part``, in the order of ``bucket`` then ``order``.

    A plain window over ``part`` would bring each part into one task.  Rows are
    numbered inside (part, bucket) instead; the counts of the buckets, a small
    aggregate, are prefix-summed and added.  ``part`` and ``bucket`` must hold
    no nulls.  The counts are a second, column-pruned read of the input, or of
    ``like``, which has the same rows.
    """
    keys = [*part, *bucket]
    n, before, rank = free_name(df.withColumn(out, F.lit(0)), "__n", "__before", "__inner_rank")
    w = Window.partitionBy(*part).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = (df if like is None else like).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    offsets = counts.select(*keys, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(before))
    inner = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return inner.join(offsets, keys).withColumn(out, F.col(rank) + F.col(before)).drop(rank, before)


def digest(*parts: Column | str | int) -> Column:
    """The MD5 of the parts as hex digits; plain SQL has it too. Null parts count as the text ``null``."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]).cast("binary"))


def leading(hexed: Column, digits: int, start: int = 1) -> Column:
    """The number that ``digits`` (13 at most) of a digest are, from the place ``start``, as a double."""
    return F.conv(F.substring(hexed, start, digits), 16, 10).cast("double")


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most about ``limit`` bytes of ``column`` (one row at least), with its values; null is empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_string(col.type):
            col = col.cast(pa.binary())
        elif pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            part = col.slice(start, stop - start).to_pylist()
            yield batch.slice(start, stop - start), [x if x is not None else b"" for x in part]
            start = stop


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a worker that gives the memory it no longer needs back when a task is done.

    Workers wait for the next task with what their allocators have kept, which
    counts as the executor's memory.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


import pyarrow.compute  # noqa: E402  pa.compute is used above
