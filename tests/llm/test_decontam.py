import hashlib
import random
import re

import pytest

from termloom.llm.decontam import drop_contaminated, mark_contaminated, n_hit

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_brute_force(spark, block):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    vocabulary = ["the", "Of", "a1", "été", "X", "zz", "and", "tion"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 12, 30]) if i > 3 else 14)) for i in range(12)] + [(None, text(11)), (77, None), (78, " .. ")]
    items = [(i, t if t is None or len(words(t)) > 2 else t + " rare words here") for i, t in items]
    docs = [(d, text(rng.randint(0, 60))) for d in range(40)]
    docs += [(100 + k, text(5) + ", " + str(items[k][1]).upper().replace("É", "é") + "! " + text(4)) for k in range(12)] + [(None, None), (100, items[3][1]), (100, items[3][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, items int, __raw string")
    marked = mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), 10, ["doc_id"], block)
    got = marked.select("doc_id", "n_words", n_hit(), F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, items), key=str)
    clean = drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _, h, _, _ in brute(docs, items) if not h), key=str)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_longest_matches(spark, block):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 60)))) for i in range(10)]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = items[rng.randrange(10)][1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randint(3, 60)]), " ".join(rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(0, 6)))]
        docs.append((d, " ".join(parts)))
    got = mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, ["doc_id"], block).collect()
    many = 0
    for r in got:
        t = docs[r.doc_id][1].split()
        best = 0
        for _, x in items:
            x = x.split()
            for i in range(len(t)):
                for j in range(len(x)):
                    k = 0
                    while i + k < len(t) and j + k < len(x) and t[i + k] == x[j + k]:
                        k += 1
                    best = max(best, k)
        if r.hit_ranges:
            many += 1
            assert r.longest == best
            x = items[int(r.longest_item)][1].split()
            assert t[r.longest_at : r.longest_at + best] == x[r.longest_item_at : r.longest_item_at + best]
        else:
            assert (r.longest, r.longest_at, r.longest_item) == (0, -1, None) and best < 5
    assert many > 30


def test_long_text(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50)}" for _ in range(300_000)]
    item = " ".join(f"x{i}" for i in range(200))
    docs = spark.createDataFrame([(1, " ".join([*words, item, *words])), (2, None), (3, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in mark_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert (r[1].longest, r[1].longest_at, r[1].longest_item, r[1].longest_item_at) == (200, 300_000, "7", 0)
    assert r[2].n_words == r[3].n_words == r[2].longest == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in mark_contaminated(docs, none).collect()] == [2]
    assert mark_contaminated(docs.limit(0), none).count() == 0
