import numpy as np
from pyspark.sql import functions as F

from termloom.llm.ann import nearest_neighbours


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] + [1.0] * 11), (5003, [1.0] * 3), (5004, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute(rows, 10)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = [len({i for i, _ in want[q]} & {i for i, _ in g.values()}) for q, g in got.items()]
    assert sum(hits) >= 0.9 * 10 * len(want)
    by = dict(rows)
    for q, g in got.items():
        for i, s in g.values():
            assert abs(s - float(np.dot(np.float64(by[q]), np.float64(by[i])))) < 1e-9
        assert [(-s, i) for i, s in (g[r] for r in range(1, 11))] == sorted((-s, i) for i, s in g.values())


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert nearest_neighbours(df.limit(0), F.lit(True), 3).count() == 0
