"""Files as a stream.

A file stream with a checkpoint takes the place of manifests of finished files:
a restart goes on where it stopped, changed settings need a new checkpoint.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.dictionary import Dictionary
from termloom.plans.analysis import Analysis, Spec


def signature(files: list[tuple[str, int, float]], settings: dict) -> str:
    """What a checkpoint belongs to: files with sizes and times, and all settings."""
    return hashlib.sha1(json.dumps([sorted(files), settings], ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()


def parquet_stream(spark: SparkSession, path: str, schema, most_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def run_stream(records: DataFrame, dictionary: Dictionary, spec: Spec, sink: Callable[[Analysis, int], None], checkpoint: str) -> StreamingQuery:
    """Analyse each micro-batch of ``records`` and hand the lazy results to ``sink``; ends when all files there are done.

    ``sink`` may see a batch again after a failure and should write by batch id.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(Analysis(batch, dictionary, spec), number)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_counts(parts: DataFrame, ids: list[str]) -> DataFrame:
    """Counts of many batches as one: sums of sums are the sums of all."""
    from pyspark.sql import functions as F

    return parts.groupBy(*ids, "keyword").agg(F.sum("n").alias("n"))
