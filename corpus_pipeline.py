"""From raw documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of documents. ``run`` writes and rereads every stage's result,
so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm.decontam import drop_contaminated
from termloom.llm.jaccard import drop_similar
from termloom.llm.mixing import draw
from termloom.llm.quality import fit, labelled_sample, score_quality
from termloom.llm.sharding import shard_rows
from termloom.session import ship, stage, table

QUALITY = 0.3
SHARDS = 40


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY.

    Null and empty texts are scored as empty; repeated rows stay or go together;
    an empty table stays empty; columns named like the scores are kept.
    """
    ship(spark)
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels")))
    kept = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() in ("score", "predicted")})
    passed = score_quality(kept, model, QUALITY).filter("predicted = 1").drop("score", "predicted")
    return passed.toDF(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: exact Jaccard of 0.8 or more on shingles of five words.

    The smallest doc_id stays, null last, ties by a hash of the text. Null and
    empty texts are near copies of each other; of repeated rows one stays; an
    empty table stays empty; other columns, whatever their names, are kept.
    """
    ship(spark)
    return drop_similar(docs, words=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts stay; repeated rows stay or go together; an empty table
    stays empty; other columns, whatever their names, are kept.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own; null and empty texts have no words;
    repeated rows are drawn each for itself; an empty table stays empty; other
    columns, whatever their names, are kept.
    """
    ship(spark)
    return draw(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard, slot and grown_shard.

    Rows of one doc_id, null too, share a shard; repeated rows get slots of their
    own; an empty table stays empty; columns named like the three are replaced.
    """
    ship(spark)
    return shard_rows(docs, (1.0,) * SHARDS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: The classifier and the near copies cannot be written in SQL; tests/llm/test_pipeline.py compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
