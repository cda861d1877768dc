"""Nearest neighbours by an inverted file with product-quantised residuals.

Rows are indexed under the nearest of some coarse centroids; what is left after
subtracting it is coded by the nearest codewords of its parts.  A query probes
the cells whose centroids have the largest inner product with it, reads
approximate scores of their rows from one table of products a part
(asymmetric distances), and the best of each cell are reranked by their exact
inner products.  Centroids and codewords are fitted on a bounded sample; every
row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import stage

#: Rows the centroids and codewords are fitted on, in the order of a hash of the vector.
SAMPLE = 20_000
MOST_CELLS = 4096
PARTS, WORDS = 16, 256
#: Rows of a cell that one task looks at together; larger cells are dealt over several.
BLOCK = 2048
#: Rows of a cell kept by their approximate score for the exact one, for each neighbour wanted.
RERANK = 2
#: The share of true neighbours that the cells probed must hold, measured on the sample.
AIM = 0.95
#: Parts that a query's lists of neighbours are merged in.
MERGES = 64
SEED = 11


@dataclass
class Index:
    """Centroids, codewords (parts x words x width), the sample, and how many cells to probe. Bounded by the constants above."""

    centroids: np.ndarray
    codewords: np.ndarray
    sample: np.ndarray
    probes: int
    width: int

    def parts(self, x: np.ndarray) -> np.ndarray:
        n, m, w = len(x), self.codewords.shape[0], self.codewords.shape[2]
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(n, m, w)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        p = self.parts(residual)
        return np.stack([nearest(p[:, i], self.codewords[i]) for i in range(p.shape[1])], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of the queries' parts with all codewords: (part, query, word)."""
        return self.parts(queries).transpose(1, 0, 2) @ self.codewords.transpose(0, 2, 1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():  # empty centres start again at rows
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def fit(sample: np.ndarray, rows: int, k: int) -> Index:
    """Fit on ``sample`` for a table of ``rows`` vectors; the cells grow with the square root of the rows."""
    rng = np.random.default_rng(SEED)
    n, width = sample.shape
    cells = max(1, min(int(rows**0.5), MOST_CELLS, n // 8))
    centroids = k_means(sample, cells, 8, rng)
    own = nearest(sample, centroids)
    parts = min(PARTS, width)
    w = -(-width // parts)
    residual = np.pad(sample - centroids[own], ((0, 0), (0, parts * w - width))).reshape(n, parts, w)
    codewords = np.stack([k_means(residual[:, i], min(WORDS, n), 5, rng) for i in range(parts)])
    # cells needed: rank of the cell of each true neighbour of some sample rows
    asked = rng.choice(n, min(n, 400), replace=False)
    ranks = []
    for i in range(0, len(asked), 50):
        q = sample[asked[i : i + 50]]
        near = np.argpartition(-(q @ sample.T), min(k, n - 1), axis=1)[:, : k + 1]
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, own[near], axis=1).ravel())
    probes = int(np.quantile(np.concatenate(ranks), AIM)) + 1
    return Index(centroids, codewords, sample, min(cells, probes), width)


def _vectors(column, width: int) -> np.ndarray:
    raw = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, width)


def usable(v: Column) -> Column:
    """No nulls, all components finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _packed(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids, asked) of the distinct vectors: their doubles as bytes, the k + 1 smallest ids, whether one is a query.

    More rows of one vector can be no query's neighbours.  Each batch is packed
    before the shuffle, so that a vector of very many rows is a few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ascontiguousarray(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype("<f8")) + 0.0
            raw = pd.DataFrame({"v": [r.tobytes() for r in x], "id": b.column(0).to_numpy(zero_copy_only=False), "asked": b.column(2).to_numpy(zero_copy_only=False)})
            g = raw.sort_values("id").groupby("v", sort=False)
            ids = g["id"].agg(lambda s: s.tolist()[: k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids.index.tolist(), pa.binary()), pa.array(ids.tolist(), pa.list_(pa.int64())), pa.array(g["asked"].any().tolist(), pa.bool_())], ["v", "ids", "asked"])

    packed = rows.select("vec_id", "embedding", "asked").mapInArrow(run, "v binary, ids array<long>, asked boolean")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return packed.groupBy("v").agg(least.alias("ids"), F.bool_or("asked").alias("asked"))


def _search(index, k: int, everything: bool):
    """Neighbours of the queries of one block of a cell; a row a query with any."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"q": [], "found": []}, dtype=object)
        ix: Index = index.value
        x, q = _vectors(rows["v"], ix.width), _vectors(asked["q"], ix.width)
        codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(x), -1)
        least = asked["least"].to_numpy()
        raw, ids = asked["q"].to_numpy(), rows["ids"].to_numpy()
        keep = len(x) if everything else min(len(x), RERANK * (k + 1))
        out_q, out = [], []
        for i in range(0, len(q), 64):
            part = q[i : i + 64]
            if keep < len(x):
                tables = ix.tables(part)
                near = sum(tables[m][:, codes[:, m]] for m in range(codes.shape[1]))  # the centroid's product is the same for all rows
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            else:
                best = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
            exact = (x[best] * part[:, None, :]).sum(axis=2)
            ok = exact >= least[i : i + 64, None]
            for j in np.flatnonzero(ok.any(axis=1)).tolist():
                good = np.flatnonzero(ok[j])
                score = np.sort(exact[j, good])[::-1]
                good = good[exact[j, good] >= score[min(k, len(good) - 1)]]  # k + 1 and what ties with the last
                out_q.append(raw[i + j])
                out.append([{"score": float(exact[j, g]), "ids": ids[best[j, g]]} for g in good.tolist()])
        return pd.DataFrame({"q": out_q, "found": out}, dtype=object)

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row, largest inner product first, ties to the smaller vec_id.

    A row's own vec_id is not among its candidates. Vectors that are null, hold
    null or non-finite components or only zeros, or whose length is not the
    table's most common one, and rows without vec_id, take no part. Repeated
    vectors are one entry of the index. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("asked")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common.n
    good = good.filter(F.size("embedding") == width).withColumn("asked", F.coalesce("asked", F.lit(False)))
    packed = stage(_packed(good, k))
    total = packed.count()
    sample = _vectors([bytes(r.v) for r in packed.select("v").orderBy(F.xxhash64(F.lit(SEED), "v"), "v").limit(SAMPLE).toLocalIterator()], width)
    index = spark.sparkContext.broadcast(fit(sample, total, k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(0), width)
                cell = ix.cells(x)
                code = ix.encode(x - ix.centroids[cell])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["v", "ids", "asked", "cell", "code"])

    indexed = stage(packed.mapInArrow(place, "v binary, ids array<long>, asked boolean, cell int, code binary"))
    sizes = {r.cell: r["count"] for r in indexed.groupBy("cell").count().toLocalIterator()}  # a row a cell, MOST_CELLS at most
    cells = np.array([sizes.get(i, 0) for i in range(len(index.value.centroids))])
    blocks = np.maximum(1, -(-cells // BLOCK))

    def probe(batches: Iterator[pa.RecordBatch], everywhere: bool) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        sample_cells = ix.cells(ix.sample)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                q = _vectors(part.column(0), width)
                order = np.argsort(-(q @ ix.centroids.T), axis=1, kind="stable")
                enough = np.argmax(np.cumsum(cells[order], axis=1) >= min(cells.sum(), 3 * (k + 1)), axis=1) + 1
                first = [order[j, : len(cells) if everywhere else max(ix.probes, enough[j])] for j in range(len(q))]
                least = np.full(len(q), -np.inf)
                if not everywhere and len(ix.sample) > k:
                    # the (k + 1)-th best sample row of the cells probed: there are k others no worse
                    probed = np.zeros((len(q), len(cells)), dtype=bool)
                    for j, f in enumerate(first):
                        probed[j, f] = True
                    known = np.where(probed[:, sample_cells], q @ ix.sample.T, -np.inf)
                    least = np.partition(known, -(k + 1), axis=1)[:, -(k + 1)]
                    least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
                out = [(j, c, s) for j in range(len(q)) for c in first[j].tolist() if cells[c] for s in range(blocks[c])]
                who = [j for j, _, _ in out]
                raw = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([raw[j] for j in who], pa.binary()), pa.array(least[who]), pa.array([int(c) for _, c, _ in out], pa.int32()), pa.array([s for _, _, s in out], pa.int32())], ["q", "least", "cell", "block"])

    deal = spark.createDataFrame([(i, int(n)) for i, n in enumerate(blocks)], "cell int, deal int")  # a row a cell, MOST_CELLS at most
    rows = indexed.join(F.broadcast(deal), "cell").select("v", "ids", "cell", "code", F.pmod(F.xxhash64("v"), F.col("deal")).cast("int").alias("block"))

    def search(asked: DataFrame, everywhere: bool) -> DataFrame:
        """(q, near) with the k + 1 best (-score, id) of each query vector."""
        wide = asked.repartition(max(1, spark.sparkContext.defaultParallelism), "v").mapInArrow(lambda b: probe(b, everywhere), "q binary, least double, cell int, block int")
        found = rows.groupBy("cell", "block").cogroup(wide.groupBy("cell", "block")).applyInPandas(_search(index, k, everywhere), "q binary, found array<struct<score:double,ids:array<long>>>")
        each = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("s"), i.alias("id")))))
        near = found.select("q", F.slice(F.array_sort(each), 1, k + 1).alias("near"))
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
        # a query has a list from each cell and block: merged in MERGES parts first
        part = near.withColumn("part", F.spark_partition_id() % MERGES).groupBy("q", "part").agg(best)
        return stage(part.groupBy("q").agg(best))

    asked = indexed.filter("asked").select("v")
    best = search(asked, False)
    # a query with too few neighbours in its cells is asked again everywhere
    few = min(k + 1, packed.select(F.sum(F.size("ids"))).first()[0])
    full = best.filter(F.size("near") >= few)
    short = asked.join(full, asked["v"] == full["q"], "left_anti")
    if not short.isEmpty():
        best = full.unionAll(search(short, True))
    # the bytes of the queries' vectors, made as above
    queries = good.filter("asked").select("vec_id", "embedding").mapInArrow(_bytes, "query_id long, q binary")
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = queries.join(best, "q").select("query_id", F.posexplode(own).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype("<f8") + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["query_id", "q"])
