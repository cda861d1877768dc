"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Each document of a source is expected in ``rate = target / source size`` copies.
Documents are put in a fixed order, the expected copies are prefix-summed, one
random offset a source is added, and a document is emitted once for each whole
number its interval crosses.  The order goes by size, so that the copies are
spread evenly over short and long documents.  Documents long for their target are
drawn first; the rate of the others then makes up for what the draw of the long
ones took too much or too little, so that the words taken stay near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._common import WORD, digest, distributed_rank, free_name, leading
from termloom.session import stage

#: Hex digits of a document's hash that split a size class of a source, so that a hot source is many tasks.
SPLIT = 2
#: Documents of more than this share of their source's target are drawn first.
LONG = 1 / 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row a source.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    They share ``share`` times the sum of all sizes by weight; no target exceeds
    ``most`` times its source's size, and the excess is shared again by weight.
    That is water filling: target = least(cap, level * weight), where the level
    is found by taking caps in the order of cap / weight.  The rows are one a
    source, so the windows over all of them are small.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place")
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (
        sizes.withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(w, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pool") - F.col("spent")) / F.col("left_weight"))
    )
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    t = t.withColumn("level", F.coalesce(F.min(fits).over(everything)["level"], F.max("ratio").over(everything)))
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _crossed(seed: int, part: str, name: str, no: str, rate: Column, rank: Column) -> Column:
    """Whole numbers between the prefix sums of the expected copies before and after a document."""
    offset = leading(digest(seed, part, F.col(no), F.col(name)), 8) / F.lit(float(1 << 32))
    return (F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ceil(most)); columns of these names are replaced.

    ``size`` is counted in words of the text unless another column is given, and
    ``tie`` orders rows of one doc_id and size, by the text's CRC if none is given.
    Null and empty texts have size 0, whole texts of any length count; a null
    source is a source of its own; rows of a null doc_id and repeated rows are
    documents like any other; sources without words get target 0 and no copies.
    An empty table gives no rows.  Equal rows are interchangeable, so the result
    is the same in every run.
    """
    own = ["size", "source_size", "target", "copies"]
    size = word_count(F.col("text")) if size is None else size
    tie = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if tie is None else tie
    keep = [c for c in docs.columns if c.lower() not in own]
    no, name, klass, spot, rank, key, last, long, words, rest, param = free_name(docs, *(f"__{x}" for x in ("nosource", "source", "class", "spot", "rank", "key", "tie", "long", "words", "rest", "rate")))
    # measured once; everything but the last step reads the measures
    base = docs.withColumns({words: size, last: tie}).drop(*own)
    base = base.withColumns({no: F.col("source").isNull(), name: F.coalesce("source", F.lit("")), key: digest(seed, F.col("doc_id"), F.col(last))})
    bits = F.bin(F.col(words))
    base = base.withColumns({klass: F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)), spot: F.substring(key, 1, SPLIT)})
    measures = stage(base.select(no, name, words, klass, spot, key, "doc_id", last))
    sizes = measures.groupBy(no, name).agg(F.sum(words).alias("source_size")).select(F.when(~F.col(no), F.col(name)).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, most).select(F.col("source").isNull().alias(no), F.coalesce("source", F.lit("")).alias(name), "source_size", "target")
    targets = stage(targets)
    order = [F.col(words), F.col(key), F.col("doc_id"), F.col(last)]
    is_long = F.col(words) > F.col("target") * F.lit(LONG)
    # the long ones, and what is left for the others
    marked = measures.join(targets, [no, name]).withColumn(long, is_long)
    drawn = distributed_rank(marked.filter(long), [no, name], [klass, spot], order, rank)
    taken = drawn.withColumn("copies", _crossed(seed + 1, "long", name, no, F.col("target") / F.col("source_size"), F.col(rank)))
    taken = taken.groupBy(no, name).agg(F.sum(F.col("copies") * F.col(words)).alias("__taken"), F.sum(words).alias("__long"))
    left = F.col("source_size") - F.coalesce("__long", F.lit(0))
    rate = F.when(left > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col("target") - F.coalesce("__taken", F.lit(0))) / left))).otherwise(0.0)
    rates = stage(targets.join(taken, [no, name], "left").select(no, name, "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(param), rate.alias(rest)))
    # all documents
    ranked = distributed_rank(base.join(rates, [no, name]).withColumn(long, is_long), [no, name, long], [klass, spot], order, rank, marked)
    copies = F.when(F.col(long), _crossed(seed + 1, "long", name, no, F.col(param), F.col(rank))).otherwise(_crossed(seed + 1, "rest", name, no, F.col(rest), F.col(rank)))
    return ranked.withColumns({"size": F.col(words), "copies": copies}).select(*keep, *own)


def emit(mixed: DataFrame) -> DataFrame:
    """A row for each copy that ``mix_sources`` gave, without its columns."""
    (copy,) = free_name(mixed, "__copy")
    rows = mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.drop(copy, "size", "source_size", "target", "copies")


def draw(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as often as ``mix_sources`` takes each row, with their own columns, whatever their names."""
    own = ("size", "source_size", "target", "copies")
    put_by = dict(zip([c for c in docs.columns if c.lower() in own], free_name(docs, *(f"__{c}" for c in docs.columns if c.lower() in own))))
    taken = emit(mix_sources(docs.withColumnsRenamed(put_by), **how))
    return taken.withColumnsRenamed({v: k for k, v in put_by.items()}).select(*docs.columns)
