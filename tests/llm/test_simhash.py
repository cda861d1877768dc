import random

import numpy as np
import xxhash

from termloom.llm.components import components
from termloom.llm.simhash import drop_near_duplicates, fingerprint, link_list, links, list_masks, near, near_duplicates, shared_bytes


def brute(values, bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_clusters(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    want = brute(sorted(values), 2)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in components(links(prints, 2)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_long_lists_agree_with_short_ones():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 2, 3):
        for spread in (0xFF, 0xFFFF, 0xFF00FF, 0x1F1F1F1F):
            members = np.unique(rng.integers(0, 1 << 32, 500).astype(np.uint64) & np.uint64(spread))
            want = brute([int(x) for x in members], bits)
            for most in (1 << 20, 40, 1):
                root = link_list(members, bits, most).tolist()
                mine = dict(zip(members.tolist(), root))
                assert {(want[a] == want[b]) == (mine[a] == mine[b]) for a in want for b in list(want)[::7]} == {True}, (bits, spread, most)


def test_tally_reaches_the_minimum():
    rng = random.Random(9)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for _ in range(rng.randint(0, 5)):
            y ^= 1 << rng.randrange(64)
        a, b = np.array([x], np.uint64), np.array([y], np.uint64)
        assert shared_bytes(a, b)[0] == sum(x >> s & 255 == y >> s & 255 for s in range(0, 64, 8))
        for bits in range(7):
            close = bin(x ^ y).count("1") <= bits
            assert near(a, b, bits)[0] == close
            assert not close or any(x & m == y & m for m in list_masks(bits))


def test_fingerprint_by_hand():
    for text in (b"", b"One", b"a b", b"the cat\tsat on the mat the cat sat on the mat", "É b c D".encode()):
        w = text.lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert fingerprint(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_texts_by_brute_force(spark):
    rng = random.Random(12)
    word = [f"w{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two")]
    for k in range(25):
        base = [rng.choice(word) for _ in range(rng.randint(3, 400))]
        rows += [(10 * k + 10 + j, " ".join([*base[: rng.randint(len(base) // 2, len(base))], *([rng.choice(word)] if j else [])])) for j in range(4)]
        rows.append((10 * k + 15, " ".join([*base, rng.choice(word)])))
    rows.append((999, "long " * 200_000))
    prints = {i: fingerprint((t or "").encode()) for i, t in rows}
    want = {}
    group = brute(sorted(set(prints.values())), 2)
    for i, p in prints.items():
        want[i] = min(j for j, q in prints.items() if group[q] == group[p])
    assert len(set(want.values())) < len(rows) - 3
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i, _ in rows}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `TEXT_` string, __key int"


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (7, None), (None, ""), (None, "x y z"), (5, "a b c d"), (9, "q")]
    docs = spark.createDataFrame([(i, t, None, None, None, "z", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (None, 7), (None, None), (5, 3), (9, 9)], key=str)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "A b c d"), (7, None), (None, "x y z"), (9, "q")], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0
