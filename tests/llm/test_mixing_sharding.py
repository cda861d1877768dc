import zlib
from collections import defaultdict

from termloom.llm.mixing import emit, mix_sources
from termloom.llm.sharding import shard_rows

SCHEMA = "doc_id long, text string, source string, size int, Shard int, __rank string"


def water(sizes, weights, pool):
    """Targets by sharing again and again what is above twice a source's size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), pool
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def rows(spark):
    docs = [(i, "w " * (1 + i % 37), f"s{i % 3 if i % 2 else 0}") for i in range(900)] + [(2000 + i, "a b", None) for i in range(20)]
    docs += [(3000, None, "s1"), (3001, "", "é"), (None, "x y z", "s2"), (5, "w " * 6, "s2"), (5, "w " * 6, "s2")]
    return docs, spark.createDataFrame([(i, t, s, 1, 2, "r") for i, t, s in docs], SCHEMA)


def test_mix(spark):
    docs, df = rows(spark)
    got = mix_sources(df).collect()
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want = water(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    again = {(r.doc_id, r.text, r.source, r.copies) for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.source, r.copies) for r in got}
    assert emit(mix_sources(df)).count() == sum(r.copies for r in got)
    assert mix_sources(df.limit(0)).count() == 0


def test_shards(spark):
    docs, df = rows(spark)
    got = shard_rows(df, (1.0,) * 7).collect()
    assert len(got) == len(docs)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 7
    assert max(map(len, by.values())) < 2 * min(map(len, by.values()))
    home = {r.doc_id: r.shard for r in got}
    assert len({r.shard for r in got if r.doc_id == 5}) == 1 and None in home
    grown = {r.doc_id: r.shard for r in shard_rows(df, (1.0,) * 8).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in got}
    heavy = shard_rows(df, (3.0, 1.0)).collect()
    assert sum(r.shard == 0 for r in heavy) > 2 * sum(r.shard == 1 for r in heavy)
    assert shard_rows(df.limit(0)).count() == 0 and zlib.crc32(b"") == 0
