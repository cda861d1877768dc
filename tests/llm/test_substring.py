import random

import pytest

from termloom.llm import substring
from termloom.llm.substring import drop_repeats


def brute(docs, size):
    seen, out = set(), []
    done = {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        if (d, t) in done:
            out.append(done[d, t])
            continue
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone |= set(range(i, i + size))
            seen.add(k)
        done[d, t] = (d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))
        out.append(done[d, t])
    return sorted(out, key=str)


def run(spark, docs, size):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, th int, places string")
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in drop_repeats(df, size).collect()), key=str)


@pytest.mark.parametrize("hot", [2, 512])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(2)
    words = ["a", "b", "the", "é", "Of.", "zz"] + [f"w{i}" for i in range(60)]
    text = lambda n, k=66: " ".join(rng.choice(words[:k]) for _ in range(n))
    passages = [text(rng.randint(20, 60)) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, len(p) - 1)
            parts += [" ".join(p[a : a + rng.randint(5, 60)]), text(rng.randint(0, 20))]
        docs.append((d, "\n".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (100, docs[3][1]), (102, "a a " * 60), (103, "a a " * 60 + "b"), (104, text(200, 2)), (105, None), (None, docs[5][1]), (106, ""), (107, text(120, 3) + " " + text(120, 3))]
    assert run(spark, docs, 20) == brute(docs, 20)
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_anchors(spark):
    rng = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(40))
    docs = [(d, " ".join(f"u{rng.randint(0, 30)}" for _ in range(15)) + f" {hot} " + " ".join(f"v{rng.randint(0, 30)}" for _ in range(15))) for d in range(700)]
    assert run(spark, docs, 20) == brute(docs, 20)


def test_the_index_decides(spark, monkeypatch):
    rng = random.Random(7)
    shared = " ".join(f"s{i}" for i in range(80))
    docs = [(d, f"{' '.join(f'u{rng.randint(0, 300)}' for _ in range(30))} {shared} {' '.join(f'v{rng.randint(0, 300)}' for _ in range(30))}") for d in range(30)]
    docs += [(40, f"{shared} x {shared}"), (41, docs[3][1])]
    assert run(spark, docs, 20) == brute(docs, 20)
    # without what the search finds only the whole copy goes
    monkeypatch.setattr(substring, "earlier_windows", lambda rows, window: ([[] for _ in rows], [0] * len(rows)))
    assert [d for d, _, n, _ in run(spark, docs, 20) if n] == [41]


def test_long_text(spark):
    rng = random.Random(3)
    docs = [(1, " ".join(f"w{rng.randint(0, 40)}" for _ in range(60_000))), (2, "a " * 60_000), (3, " ".join(f"w{i}" for i in range(50)) + " " + "a " * 100)]
    assert run(spark, docs, 20) == brute(docs, 20)
