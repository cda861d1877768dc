"""Session settings that every plan of the package relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed on them.

    Local runs start workers whose import path is taken from the environment,
    so the directory of the package is added to it.  On a cluster the package
    is installed or sent with ``--py-files``; the extra entry is then harmless.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in known if p]])
    return spark


#: Bytes of a single file that are worth a shuffle, and up to which it costs little.
SPREAD = 1 << 20, 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder.

    A single file may be one row group, which one task reads and works on alone;
    within the bounds of SPREAD its rows, after filters and pruning, are dealt
    over all cores. Tables of several files are read as they are.
    """
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if SPREAD[0] <= size <= SPREAD[1] and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one is made only where there is none and the master is local."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not known:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            known = tempfile.mkdtemp(prefix="termloom-checkpoint-")
        sc.setCheckpointDir(known)
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Cuts the lineage, survives lost executors, and leaves no partitioning behind
    that would keep Spark from splitting skewed keys of a later join.  The files
    go with ``unstage``, or else when the application ends.  ``codec`` is for
    long texts, which zstd makes much smaller than the usual one.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = jpath
    return out


def unstage(*staged: DataFrame) -> None:
    """Delete the files of tables made by ``stage`` that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        df._staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(df._staged, True)
