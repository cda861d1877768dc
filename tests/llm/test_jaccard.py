import random

import numpy as np

import corpus_pipeline
from termloom.llm.jaccard import differing, drop_similar, sketch


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """The doc_ids that stay of (doc_id, text) with distinct ids: the least of each component of Jaccard >= 0.8."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in sets})


def near_copies(seed=5):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(3000)]
    line = [rng.choice(word) for _ in range(30)]
    rows = [(900, None), (901, ""), (902, "A b c"), (903, "a B c"), (904, " ".join(line))]
    for k in range(40):
        base = [rng.choice(word) for _ in range(rng.randint(20, 300))] + (line if k % 3 == 0 else [])
        rows.append((10 * k, " ".join(base)))
        for j in range(1, rng.randint(2, 5)):
            other = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = rng.choice(word)
            rows.append((10 * k + j, " ".join(other)))
    return rows


def test_every_pair_of_four_fifths_is_found(spark):
    rows = near_copies()
    sets = [grams(t) for _, t in rows]
    like = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a | b]
    assert sum(0.8 <= x < 0.95 for x in like) > 10 and sum(0.6 <= x < 0.8 for x in like) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    assert sorted(r.doc_id for r in drop_similar(docs).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(0, 600)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, 300)).astype(np.uint64)])) for _ in "ab")
        apart = len(np.setxor1d(a, b))
        assert differing(sketch(a), sketch(b)) <= apart
        if apart > 100 and 0.8 < len(a) / len(b) < 1.25:
            assert differing(sketch(a), sketch(b)) > apart / 3
    assert differing(sketch(both[:0]), sketch(both[:0])) == 0


def test_odd_rows(spark):
    schema = "doc_id long, text string, `TEXT_` string, __key int, n int, g int"
    rows = [(5, "a b c d"), (3, "A b c d"), (7, None), (None, ""), (None, "x y z"), (5, "a b c d"), (9, "q")]
    docs = spark.createDataFrame([(i, t, "z", 1, 2, 3) for i, t in rows], schema)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "A b c d"), (7, None), (None, "x y z"), (9, "q")], key=str)
    assert drop_similar(docs.limit(0)).count() == 0
