"""The pipeline and the registered queries on small tables, against plain Python."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from termloom.llm import queries as Q
from termloom.llm.quality import fit, labelled_sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word_list(text):
    return (text or "").split()


def md5(*parts):
    return hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()


def near_dedup(rows):
    """One row of each component of Jaccard >= 0.8 on five-word shingles."""
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [grams(word_list((r[1] or "").lower())) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        first.setdefault(find(i), rows[i])
    return list(first.values())


def clean(rows, items):
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t or "").split()
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    held = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return [r for r in rows if not held(words(r[1]))]


def copies(rows):
    """The copies of (doc_id, size, source, crc) rows, by the rules of the mix one row after the other."""
    sizes = Counter()
    for _, n, s, _ in rows:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: left * weight[s] / total for s in free}
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    out = {}
    for s in order:
        taken = big = 0
        for part in ("long", "rest"):
            own = [r for r in rows if r[2] == s and (r[1] > target[s] / 64) == (part == "long")]
            own.sort(key=lambda r: (f"{len(f'{r[1]:b}'):02}{f'{r[1]:b}'[:3]}", md5(17, r[0], r[3])[:2], r[1], md5(17, r[0], r[3]), r[0] or 0, r[3]))
            offset = int(md5(18, part, "true" if s is None else "false", s or "")[:8], 16) / 2**32
            rate = (target[s] / sizes[s] if sizes[s] else 0.0) if part == "long" else min(2.0, max(0.0, (target[s] - taken) / (sizes[s] - big))) if sizes[s] > big else 0.0
            for k, r in enumerate(own, 1):
                out[r] = math.floor(offset + rate * k) - math.floor(offset + rate * (k - 1))
                taken, big = taken + out[r] * r[1], big + r[1]
    return out, target


def shard_of(doc_id, n):
    key = "null" if doc_id is None else str(doc_id)
    return min(range(n), key=lambda s: -math.log((int(md5(29, s // 4, key)[s % 4 * 8 : s % 4 * 8 + 8], 16) + 0.5) / 2**32))


def corpus():
    rng = random.Random(21)
    words = ["the", "of", "and", "theren", "ontion", "which", "inger", "ander", "noch", "tion"]
    good = lambda n=60: " ".join(rng.choice(words) + rng.choice(["", "", rng.choice("abcdefgh")]) for _ in range(n)) + "."
    bad = lambda: rng.choice(["X!! Y!! " * 30, "a | b | " * 30, f"{rng.choice(words)} " * 50])
    items = [(i, good(25)) for i in range(4)] + [(9, None), (10, "zq zx zv")]
    rows = [(i, good(rng.randint(30, 90)) if i % 4 else bad(), "en", rng.choice(["s1", "s2", "é", None]), 1) for i in range(240)]
    rows += [(300 + i, rows[i * 4 + 1][1] + " more", "en", "s1", 2) for i in range(20)] + [(330 + i, f"{good(20)} {items[i % 4][1]} {good(20)}", "de", "s2", 3) for i in range(8)]
    rows += [(None, good(40), None, None, None), (400, None, None, "s1", 0), (401, "", "en", "s2", 0), (402, good(30_000), "en", "é", 7)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)]
    return rows, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_run_by_brute_force(spark, tables):
    rows, _, items = corpus()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    scores = model.score([(r[1] or "").encode() for r in rows])
    passed = [r for r, s in zip(rows, scores) if s >= 0.3]
    assert sum(r[0] is not None and r[0] < 240 and r[0] % 4 > 0 for r in passed) > 170 and len(passed) < len(rows) - 40
    kept = clean(near_dedup(passed), items)
    measured = {(r[0], len(word_list(r[1])), r[3], zlib.crc32((r[1] or "").encode())): r for r in kept}
    n, target = copies(list(measured))
    want = Counter({measured[k]: c for k, c in n.items() if c})
    got = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == shard_of(r.doc_id, 40) and r.grown_shard == shard_of(r.doc_id, 41)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for s in target:
        taken = sum(c * k[1] for k, c in n.items() if k[2] == s)
        assert abs(taken - target[s]) <= max(60, 0.05 * target[s]) or any(k[2] == s and k[1] > target[s] / 2 for k in n)


def test_stages_on_odd_tables(spark, tables):
    rows, _, _ = corpus()
    odd = [(*r, 1.0, "x", 2, "y", 3) for r in [*rows[:40], *rows[-4:], rows[1], rows[1]]]
    docs = spark.createDataFrame(odd, f"{SCHEMA}, score double, Predicted string, items int, shard string, SIZE int")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, tables)
        assert out.columns[:5] == docs.columns[:5], name
        assert out.count() > 0, name
        assert step(spark, docs.limit(0), tables).count() == 0, name
        if name != "sharding":
            assert out.columns == docs.columns, name
            alike = {tuple(r) for r in docs.collect()}
            assert {tuple(r) for r in out.collect()} <= alike, name
    empty = spark.createDataFrame([], SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    assert corpus_pipeline.STAGES[1][1](spark, empty, tables).count() == 0


def test_registered_digests(spark, tables):
    rows, _, _ = corpus()
    found = __spark_entry__.queries()
    assert set(Q.QUERIES) <= set(found) and "pipeline" in found
    mixed = Q.op1_source_mix(spark, tables).collect()
    n, target = copies([(r[0], len(word_list(r[1])), r[3], zlib.crc32((r[1] or "").encode())) for r in rows])
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixed) == Counter((k[0], k[1], c * k[1]) for k, c in n.items())
    sharded = Q.op2_rendezvous_shards(spark, tables).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in sharded} == {
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "key", shard_of(r[0], 40), shard_of(r[0], 41)) for r in rows
    }
    prints = Q.op3_byte_index_simhash(spark, tables).collect()
    assert len(prints) == len(rows) and all(len(r.fingerprint) == 16 for r in prints)
    secrets = {r.doc_id: r for r in Q.op6_guess_cost_secrets(spark, tables).collect()}
    assert secrets[400].spans == "" and secrets[400].base_sha256 == hashlib.sha256(b"").hexdigest()
    leaked = {r.doc_id for r in Q.op10_suffix_array_decontam(spark, tables).collect() if r.contaminated}
    assert leaked == {r[0] for r in rows} - {r[0] for r in clean(rows, corpus()[2])} and len(leaked) == 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_held_out_quality(spark):
    got = Q.op7_random_index_quality(spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality is not null")
    rows = got.join(labels, "doc_id").select("score", "predicted", "quality").collect()
    s, p, y = (np.array([r[i] for r in rows]) for i in range(3))
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = int(y.sum())
    assert len(y) > 500 and (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)) > 0.98 and (p == y).mean() > 0.97
