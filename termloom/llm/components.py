"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import stage, unstage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang nodes on the least node next to them; ``edges`` go from a to a smaller b and are deleted."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # staged, so that the join below can split the neighbours of a node that has very many
    least = stage(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    both = seen.join(least, "u")
    if large:
        out = both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = stage(out.filter("a > b").distinct())
    unstage(edges, least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)`` whose component has several; root is its least node.

    The number of rounds grows with the logarithm of the longest path. Each is
    written to the shared folder, so that a lost executor costs one round.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = _mark(edges)
    for _ in range(most_rounds if mark[0] else 0):
        edges = _star(_star(edges, True), False)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
