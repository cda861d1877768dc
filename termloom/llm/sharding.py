"""Sharding by rendezvous hashing over weighted shards; DataFrame functions only.

Every shard draws a number for every key; the shard with the best number,
weighted, takes the row.  A shard's draw does not depend on the others, so one
more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import digest, distributed_rank, free_name, leading

#: Hex digits of a row's hash that split a shard for numbering its rows, so that a shard is many tasks.
SPLIT = 2


#: Draws in a digest, of DIGITS hex digits each.
DRAWS, DIGITS = 4, 8


def _draws(key: Column, shards: int, seed: int, prefix: str) -> dict[str, Column]:
    """Columns with the digests that the draws of so many shards are read from."""
    return {f"{prefix}{k}": digest(seed, k, key) for k in range(-(-shards // DRAWS))}


def _cost(shard: int, weight: float, prefix: str) -> Column:
    """-ln(u) / weight of a shard's uniform draw u; the least cost wins with odds in proportion to the weight."""
    draw = leading(F.col(f"{prefix}{shard // DRAWS}"), DIGITS, shard % DRAWS * DIGITS + 1)
    return -F.log((draw + F.lit(0.5)) / F.lit(float(1 << 4 * DIGITS))) / F.lit(float(weight))


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, grown_weight: float = 1.0, seed: int = 29, tie: Column | None = None) -> DataFrame:
    """``docs`` with shard, slot and grown_shard (where the row goes if a shard of ``grown_weight`` joins).

    doc_id and the shards decide alone: rows of one doc_id share a shard, null
    is a key like any other, the text plays no part.  Slots count a shard's
    rows from 0 without gaps, in the order of a hash of doc_id and ``tie`` (by
    default the CRC of the text, of whatever length; null texts count as empty);
    equal rows are interchangeable.  An empty table gives no rows.  Columns
    named like the three are replaced.
    """
    own = ["shard", "slot", "grown_shard"]
    docs = docs.drop(*own)
    spot, rank, draw, last, order = free_name(docs, "__spot", "__rank", "__draw", "__tie", "__order")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    (digests,) = free_name(docs, "__digest")
    found = _draws(key, len(weights) + 1, seed, digests)
    draws = [F.struct(_cost(i, w, digests).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    grown = _cost(len(weights), grown_weight, digests)
    placed = (
        docs.withColumns(found)
        .withColumns({draw: F.array_min(F.array(*draws)), last: F.crc32(F.coalesce("text", F.lit("")).cast("binary")) if tie is None else tie})
        .withColumns(
            {
                "shard": F.col(f"{draw}.shard"),
                "grown_shard": F.when(grown < F.col(f"{draw}.cost"), F.lit(len(weights))).otherwise(F.col(f"{draw}.shard")),
                order: digest(seed + 1, key, F.col(last)),
            }
        )
        .drop(*found)
        .drop(draw)
        .withColumn(spot, F.substring(order, 1, SPLIT))
    )
    ranked = distributed_rank(placed, ["shard"], [spot], [F.col(order), F.col("doc_id"), F.col(last)], rank)
    return ranked.withColumn("slot", F.col(rank) - 1).select(*docs.columns, *own)
