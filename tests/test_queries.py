"""Registered queries on small tables against plain Python."""

import random
import re
from collections import Counter

from termloom import queries as Q
from termloom import queries_io as IO


def pack(s, most=200):
    """Long pieces at commas, greedily; what is still too long at every 200 characters."""
    if len(s) <= most:
        return [s]
    out, buf = [], ""
    for piece in s.split(","):
        wider = f"{buf},{piece}" if buf else piece
        if len(wider) > most and buf:
            out.append(buf)
            buf = piece
        else:
            buf = wider
    out += [buf] if buf else []
    return [x[i : i + most] for x in out for i in range(0, len(x), most)]


def test_corpus_keeps_long_sentences(spark, tmp_path):
    rng = random.Random(2)
    words = ["the", "nation", "und", "er", "quexx", "abc"]
    made = lambda n, sep: sep.join(rng.choice(words) for _ in range(n))
    rows = [(1, made(150, "")), (2, made(120, ",")), (3, "the" * 61 + "." + made(20, "")), (4, made(400, "") + "." + made(90, ",")), (5, "the" * 65)]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want, sents = Counter(), Counter()
    for i, t in rows:
        for part in Q.han(t).split("。"):
            for s in filter(lambda s: sum("一" <= c <= "龥" for c in s) >= 8, pack(part)):
                sents[i] += 1
                for term, _, _ in Q.TERMS:
                    want[i, Q.han(term)] += s.count(Q.han(term))
    got = {(r.doc_id, r.term): r.n for r in Q.term_counts(spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert sorted(r.mda_sent for r in IO.keyword_panel(spark, str(tmp_path)).collect()) == sorted(sents.values())
    hits = Q.corpus_hit_table(spark, str(tmp_path)).collect()
    assert max(len(r.sentence) for r in hits) == 200
    scored = sum(len(s) % 13 != 0 for s in {(r.code, r.yr, r.sentence): r.sentence for r in hits}.values())
    assert sum(r.hit_sent for r in Q.firm_year(spark, str(tmp_path)).collect()) == scored


def test_ratios_join_all_customers(spark, tmp_path):
    keys = [3, 39, 40, 41, 43, 52, 85, 1234567]
    spark.createDataFrame([(k, f"c{k}") for k in keys], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(o, c, float(100 + o)) for o, c in enumerate([*keys, *keys, 80, 99] * 7, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for o, c, price in orders:
        code, year = (None if o % 17 == 0 else c), o % 7
        met = [k for k in keys if k % 7 == year and (None if k % 13 == 0 else k) == code]
        for k in met or [None]:
            n = None if k is None or k % 4 == 0 else float(k % 3 * 10)
            want.append((o, "00<NA>" if code is None else str(code).zfill(6), k and f"c{k}", n, price / n if n else None))
    got = [(r.o_orderkey, r.stkcd_key, r.c_name, r.n, r.total_ratio) for r in Q.ratio_table(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {c for _, _, c, _, _ in got} > {"c40", "c41", "c1234567"}


def test_score_panel_shuffles_texts_once(spark, tmp_path):
    """Copies of the texts for every distinct count, and a shuffle of them for every term, filled the disk."""
    rows = [(i, "the nation und quexx." * 3 + "er the tion que und" * (1 + i % 3) + f".tion{'abcdefgh'[i % 8]}the que er", "s") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = IO.score_panel(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "sentence" in line]
    assert 1 <= len(keys) <= 2 and len({re.sub(r"#\d+L?|plan_id=\d+|^[\s:+\-]*", "", k) for k in keys}) == 1  # two that are alike are one when it runs
    assert not any("term" in k or "var" in k for k in keys)
