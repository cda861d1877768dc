import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termloom.operators import match, panel, ratios, scoring, section
from termloom.operators.dictionary import Dictionary, tiered
from termloom.plans.analysis import Analysis, Spec, missing_role
from termloom.sources.sinks import read_stata, stata_names, write_sheets, write_stata
from termloom.sources.xlsx import Workbook

HAN = "企业持续推进绿色发展和生态环境保护工作"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a.xlsx", i + 2) for i, r in enumerate(rows)], "code string, day string, body string, name string, __file string, __row long")


def test_raw_monthly_and_sheets(spark, tmp_path):
    rows = [("1.SZ", "2024-03-15", f"{HAN}。{HAN}", "甲"), ("2", "2024年3月", "没有命中的一个普通句子在这里", "乙"), ("1", "45292", HAN, "甲"), ("3", "2024年", HAN, "丙")]
    words = Dictionary({"环境": ["绿色发展", "生态环境"], "治理": ["绿色发展"], "空": []})
    spec = Spec("code", "day", ("body", "missing"), retained=("name", "code", "name"), share=True)
    raw = Analysis(frame(spark, rows), words, spec)
    main = {r["源文件行号"]: r for r in raw.main.collect()}
    assert [main[i]["公司代码"] for i in (2, 3, 4, 5)] == ["000001", "000002", "000001", "000003"]
    assert [(main[i]["环境"], main[i]["治理"], main[i]["空"], main[i]["总计"]) for i in (2, 3, 4)] == [(2, 2, 0, 4), (0, 0, 0, 0), (1, 1, 0, 2)]
    assert [main[i]["月份"] for i in (2, 3, 4, 5)] == [3, 3, 1, None] and main[3]["环境_占比"] == 0 and main[2]["name"] == "甲"
    assert raw.hits.count() == 8 and [r["分类"] for r in raw.hits.filter("`命中关键词` = '绿色发展'").distinct().collect()][0] == "治理"
    monthly = Analysis(frame(spark, rows), words, Spec("code", "day", ("body",), "monthly"))
    assert sorted((r["公司代码"], r["月份"], r["总计"]) for r in monthly.main.collect()) == [("000001", 1, 2), ("000001", 3, 4), ("000002", 3, 0)]
    total = [r for r in monthly.quality.collect() if r["文件"] == "合计"][0]
    assert (total["有效记录数"], total["进入统计记录数"], total["月份无法识别"], total["关键词命中次数"]) == (4, 3, 1, 6)
    path = str(tmp_path / "out.xlsx")
    assert write_sheets(path, monthly.sheets()) == {}
    with Workbook(path) as book:
        assert book.sheets() == ["公司月份分类统计", "公司月份关键词", "分类汇总", "数据质量", "异常记录", "输入文件清单", "运行元数据", "词典诊断", "分析说明"]
        assert list(book.rows("分类汇总"))[1][:2] == ["环境", "3"]


def test_issues_and_roles(spark):
    rows = [("", "2024-01-01", HAN, "x"), ("1", "坏", HAN, "x"), ("2", "2024-01-01", "  ", "x"), ("3", "2024-01-02", HAN, "x")]
    a = Analysis(frame(spark, rows), Dictionary({"c": ["绿色"]}), Spec("code", "day", ("body",)))
    assert sorted((r["源文件行号"], r["问题类型"]) for r in a.issues.collect()) == [(2, "公司代码为空"), (3, "年份无法识别"), (4, "文本为空")]
    assert missing_role(["day"], a.spec).startswith("缺少公司代码列") and missing_role(["code", "day"], a.spec) == "缺少已选择的文本列"
    with pytest.raises(ValueError):
        Analysis(frame(spark, rows), Dictionary({"年份": ["x"]}), a.spec)
    with pytest.raises(ValueError):
        Spec("code", "day", ("body",), "weekly")


def test_match_strategies_agree(spark):
    df = spark.createDataFrame([(1, "aAaa a.b ESG esg"), (2, ""), (3, "ab AB ba")], "i int, sentence string")
    words = ["aa", "a", "a.b", "esg", "ESG", "AB"]
    key = lambda d: sorted((r.i, r.keyword, r.n) for r in d.collect())
    assert key(match.hits(df, words)) == key(match.hits(df, words, most=0))
    cut = match.tokens(df, "sentence", match.longest_match(["a.b", "ab"]))
    assert sorted((r.i, r.keyword, r.n) for r in match.token_hits(cut, ["a.b", "ab"], ["i"]).collect()) == [(1, "a.b", 1), (3, "ab", 1)]


def test_sections():
    body = "一、报告期内经营情况\n" + "公司主营业务稳步增长，财务状况良好。" * 40
    text = f"目录\n第三节 管理层讨论与分析......12\n\n第一节 释义\n略\n第三节 管理层讨论与分析\n{body}\n第四节 公司治理\n其他"
    a, b = section.bounds(text)
    assert text[a:b].strip().startswith("第三节 管理层讨论与分析\n一、") and text[b:].startswith("第四节")
    assert section.bounds("没有标题的文本") is None and section.is_contents("") and not section.is_contents(body)
    assert section.bounds("详见管理层讨论与分析\n" + "略") is None


def test_section_files(spark):
    body = "公司主营业务稳步增长且财务状况保持良好。" * 20
    df = spark.createDataFrame([("600276_2022_甲_题_2023-01-01", "x.txt", "utf-8", f"第三节 管理层讨论与分析\n{body}\n第四节 其他\n"), ("000002_2021_乙", "y.txt", "utf-8", "无")], "stem string, source string, encoding string, text string")
    found = section.extract_sections(df)
    made = found.withColumn("text", section.structured_text(found)).select("stem", "source", "encoding", "text")
    got = {r["公司代码"]: r for r in section.sentence_counts(made).collect()}
    assert got["600276"]["提取状态"] == "success" and got["600276"]["句子数"] == 20 and got["600276"]["报告日期"] == "2023-01-01"
    assert got["000002"]["提取状态"] == "failed" and got["000002"]["句子数"] is None
    lost = section.sentence_counts(spark.createDataFrame([("a_2020_b", "z", "utf-8", "提取状态：success\n")], "stem string, source string, encoding string, text string")).collect()[0]
    assert lost["提取状态"] == "failed" and lost["说明"].startswith("缺少")


def test_scoring(spark):
    rows = [(0, "k", "c", "一句"), (1, "k", "c", "一句 "), (2, "k", "c", "二句"), (3, "k", "c", "三句"), (10_001, "k", "c", "四句"), (4, None, None, "x" * 600)]
    df = spark.createDataFrame(rows, "pos long, `命中关键词` string, `分类` string, `命中句子` string")

    def scorer(prompt):
        if "三句" in prompt:
            raise RuntimeError("boom")
        return json.dumps(dict.fromkeys(("rel", "time", "voice", "type", "cert", "quant", "tone"), 1) | {"conf": 9})

    out, cache = scoring.score_hits(df, scorer, scoring.Scoring(most=3, retries=1), "pos")
    got = {r.pos: (r["LLM分析状态"], r["LLM置信度"]) for r in out.collect()}
    assert got == {0: ("成功", 1), 1: ("成功", 1), 2: ("成功", 1), 3: ("失败", -1), 4: ("未分析", -1), 10_001: ("成功", 1)}
    held = spark.createDataFrame(cache.collect(), cache.schema)
    again, fresh = scoring.score_hits(df, F.lit("no json"), scoring.Scoring(), "pos", held)
    assert fresh.count() == 0 and {r.pos for r in again.filter("`LLM分析状态` = '成功'").collect()} == {0, 1, 2, 10_001}
    waits = []
    assert scoring.ask(lambda p: (_ for _ in ()).throw(RuntimeError("429")), "p", 2, waits.append)[1] == "429" and len(waits) == 40 and max(waits) == 60
    assert scoring.cost_estimate(0) == "unbounded"


def test_panels(spark, tmp_path):
    terms = tiered(spark, [("绿色", 1, "一"), ("环境", 2, "二"), ("未见", 2, "二"), (None, 1, "x")])
    reports = spark.createDataFrame([("000001_2020_a", f"h\n===== MDA（管理层讨论与分析）正文 =====\n{HAN}。{HAN}绿色"), ("000002_2020", "没有标记"), ("bad_2020", "x")], "stem string, text string")
    cut = panel.report_sentences(reports)
    found = panel.term_hits(cut, terms, probe=True)
    p = panel.keyword_panel(cut, found, terms)
    row = p.collect()[0]
    assert p.columns == ["公司代码", "年份", "mda_sent", "绿色", "环境", "total_freq", "total_ratio", "t1_freq", "t1_ratio", "t2_freq", "t2_ratio"]
    assert (row["mda_sent"], row["绿色"], row["环境"], row["total_ratio"]) == (2, 3, 2, 2.5)
    scored = panel.hit_table(found).withColumns({"LLM物理分数": F.lit("2"), "LLM转型分数": F.lit("0"), "LLM语气语调": F.lit(None).cast("string"), "LLM分析状态": F.lit("成功")})
    wide = panel.score_panel(p, scored, terms)
    got = wide.collect()[0]
    assert len(wide.columns) == 5 + 7 + 22 * 3
    assert (got["hit_sent"], got["phys_sum"], got["trans_zero_sent"], got["kw001_occ_all"], got["kw003_occ_all"], got["kw001_phys_neu_occ"]) == (2, 8, 2, 3, 0, 3)
    write_stata(wide, str(tmp_path / "p.dta"), {"hit_sent": "x" * 100})
    back, labels = read_stata(spark, str(tmp_path / "p.dta"))
    assert back.count() == 1 and labels["hit_sent"] == "x" * 80
    with pytest.raises(ValueError):
        stata_names(["a-b", "a_b"])


def test_ratios(spark):
    risk = spark.createDataFrame([("1", "2020", 4.0, 2.0, 1.0, 9.0), (None, "2020", 4.0, 2.0, 1.0, 9.0), ("3", "2020", 4.0, 2.0, 1.0, 9.0), ("4", "2020", 4.0, 2.0, 1.0, 9.0)], "stkcd string, year string, total_freq double, physical_freq double, transition_freq double, total_ratio double")
    sent = spark.createDataFrame([("000001", "2020", "甲", "success", "8", "9", "1"), (None, "2020", "乙", "failed", "", "", ""), ("3", "2020", "丙", "success", "0", "", "")], "`公司代码` string, `年份` string, `公司名称` string, `提取状态` string, `句子数` string, `原始句子数` string, `疑似表格段落数` string")
    got = {r.stkcd_key: (r.mda_sentence_issue, r.total_ratio, r.physical_sentence_ratio) for r in ratios.recalculate(risk, ratios.sentence_panel(sent)).collect()}
    assert got == {"000001": ("", 0.5, 0.25), "00<NA>": ("mda_extraction_failed", None, None), "000003": ("nonpositive_sentence_count", None, None), "000004": ("missing_mda_panel", None, None)}
    with pytest.raises(ValueError):
        ratios.recalculate(risk.drop("total_freq"), ratios.sentence_panel(sent))
    assert ratios.labels({"total_ratio": "词频占比"}, ["total_ratio", "zz"]) == {"total_ratio": "词频占MDA句子数比重", "zz": "zz"}


def test_stream(spark, tmp_path):
    from termloom.streaming.files import merge_counts, parquet_stream, run_stream, signature

    rows = frame(spark, [("1", "2024-03-15", HAN, "x")] * 3)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = run_stream(parquet_stream(spark, str(tmp_path / "in"), rows.schema, 1), Dictionary({"c": ["绿色"]}), Spec("code", "day", ("body",), "yearly"), lambda a, i: a.counts.write.mode("overwrite").parquet(f"{out}/b={i}"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [tuple(r) for r in merge_counts(spark.read.parquet(out), ["公司代码", "年份"]).collect()] == [("000001", 2024, "绿色", 3)]
    assert signature([("a", 1, 2.0)], {"x": 1}) != signature([("a", 1, 2.0)], {"x": 2})


def test_command_line(spark, tmp_path):
    from termloom.cli import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "000001_2022_x.txt").write_text(HAN + "。", encoding="utf-8")
    (tmp_path / "d.txt").write_text("环境：绿色,生态", encoding="utf-8")
    out = tmp_path / "o.xlsx"
    assert main(["analyse", "--data-dir", str(tmp_path / "in"), "--dict", str(tmp_path / "d.txt"), "--output", str(out), "--aggregate-year", "--export-sentences"]) == 0
    assert out.exists() and (tmp_path / "o_命中句子.csv").exists()
    assert main(["analyse", "--data-dir", str(tmp_path / "none"), "--dict", str(tmp_path / "d.txt"), "--output", str(out)]) == 2
    body = "第三节 管理层讨论与分析\n" + "公司主营业务稳步增长且财务状况保持良好。" * 20
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "600000_2021_甲_题_2022-01-01.txt").write_text(body, encoding="gb18030")
    assert main(["extract", "--src-root", str(tmp_path / "src"), "--out-root", str(tmp_path / "mda")]) == 0
    assert main(["count-sentences", "--src-root", str(tmp_path / "mda"), "--output", str(tmp_path / "s.csv")]) == 0
    assert "600000,2021,甲" in (tmp_path / "s.csv").read_text(encoding="utf-8-sig")
    assert main(["extract", "--src-root", str(tmp_path), "--out-root", str(tmp_path)]) == 2


def test_score_metrics_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["1", "000001", "2"]), rng.choice([2020, 2021]), rng.choice(["a", "b", "c"]), rng.choice(["aab", "ab b", "c", "", None]), str(rng.randint(0, 2)), str(rng.randint(0, 2)), rng.choice([None, "0", "1", "2", "7"])) for _ in range(400)]
    given = spark.createDataFrame(rows, "`公司代码` string, `年份` int, `命中关键词` string, `命中句子` string, `LLM物理分数` string, `LLM转型分数` string, `LLM语气语调` string").withColumn("LLM分析状态", F.lit("成功"))
    made = [(c.zfill(6), y, k, s, int(p), int(t), 1 if tone is None else int(tone), max(1, (s or "").count(k))) for c, y, k, s, p, t, tone in rows]
    distinct = lambda group, cond: len({r[3] for r in group if cond(r) and r[3] is not None})
    scored = panel.scored_rows(given)
    for r in panel.firm_year(scored).collect():
        g = [m for m in made if m[:2] == (r.code, r.year)]
        assert (r.hit_sent, r.phys_sum, r.trans_sum) == (distinct(g, lambda m: True), sum(m[4] for m in g), sum(m[5] for m in g))
        assert (r.phys_rel_sent, r.phys_zero_sent, r.trans_rel_sent, r.trans_zero_sent) == tuple(distinct(g, f) for f in (lambda m: m[4] >= 1, lambda m: m[4] == 0, lambda m: m[5] >= 1, lambda m: m[5] == 0))
    terms = tiered(spark, [("a", 1, "x"), ("b", 1, "x"), ("zz", 1, "x")])
    got = panel.keyword_metrics(scored, terms).collect()
    assert len(got) == len({(m[0], m[1], m[2]) for m in made if m[2] != "c"}) and len(got[0]) == 3 + 22
    for r in got:
        g = [m for m in made if m[:3] == (r.code, r.year, {"kw001": "a", "kw002": "b"}[r["var"]])]
        assert (r.occ_all, r.sent_all) == (sum(m[7] for m in g), distinct(g, lambda m: True))
        for d, i in (("phys", 4), ("trans", 5)):
            want = [sum(m[7] for m in g if m[i] >= 1), distinct(g, lambda m: m[i] >= 1), sum(m[i] for m in g), distinct(g, lambda m: m[i] == 0)]
            for tone in range(3):
                want += [sum(m[7] for m in g if m[i] >= 1 and m[6] == tone), distinct(g, lambda m: m[i] >= 1 and m[6] == tone)]
            names = ["occ", "sent", "score", "zero_sent", *(f"{t}_{n}" for t in ("neg", "neu", "pos") for n in ("occ", "sent"))]
            assert [r[f"{d}_{n}"] for n in names] == want


@pytest.mark.parametrize("most", [0, 50])
def test_distinct_hits_are_the_hit_table(spark, monkeypatch, most):
    monkeypatch.setattr(match, "MOST_COMPARED", most)
    monkeypatch.setattr(match.hits, "__defaults__", ("sentence", False, most))
    terms = tiered(spark, [("绿色", 1, "一"), ("esg", 2, "二"), ("绿色", 2, "三"), ("ESG", 3, "四"), ("未见", 2, "二")])
    cut = spark.createDataFrame([("a", "000001", 2020, ["绿色Esg", "绿色", "无", None]), ("b", "000001", 2020, ["绿色", "esG绿色"]), ("c", "000002", 2020, ["绿色"]), ("d", "000003", 2020, [])], "stem string, `公司代码` string, `年份` int, sentences array<string>")
    want = sorted(map(tuple, panel.hit_table(panel.term_hits(cut, terms)).collect()))
    assert sorted(map(tuple, panel.distinct_hits(cut, terms).collect())) == want and len(want) == 8


def plain_longest_match(words, text):
    """One place after the other: the longest word of two characters or more, a Latin run, a character."""
    out, i = [], 0
    while i < len(text):
        size = max((len(w) for w in words if len(w) > 1 and text.startswith(w, i)), default=0)
        m = None if size else re.compile("[A-Za-z0-9]+").match(text, i)
        size = size or (len(m[0]) if m else 1)
        out.append(text[i : i + size])
        i += size
    return out


def test_longest_match_against_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        words = ["".join(rng.choice("绿色环a1]^-b😀") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 6))]
        text = "".join(rng.choice("绿色环a1]^-b😀 \n保") for _ in range(rng.randint(0, 40)))
        cut, want = match.longest_match(words), plain_longest_match(words, text)
        assert cut(text) == want
        for only in (frozenset(words), frozenset(w for w in words if len(w) > 1), frozenset({"a", "保", "1b"})):
            assert cut.keeping(only)(text) == [w for w in want if w in only]


def test_tokens_are_made_of_small_parts(spark, monkeypatch):
    """A batch of ten thousand texts was cut as a whole, with an object for each character."""
    monkeypatch.setattr(match, "TOKENIZED", 40)
    words = ["绿色", "色a", "保"]
    texts = ["绿色保a绿色" * (i % 7) + "环" * (i % 3) if i % 5 else None for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
    cut = match.longest_match(words)
    assert {r.i: (r.s, r.tokens) for r in match.tokens(df, "s", cut).collect()} == {i: (t, plain_longest_match(words, t or "")) for i, t in enumerate(texts)}
    want = Counter((i, w) for i, t in enumerate(texts) for w in plain_longest_match(words, t or "") if w in words)
    for tokenizer in (cut, lambda text: plain_longest_match(words, text)):
        held = match.tokens(df, "s", tokenizer, words)
        assert max(len(r.tokens) for r in held.collect()) == 18 and {(r.i, r.keyword): r.n for r in match.token_hits(held, words, ["i"]).collect()} == want

    sizes = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sizes.extend(b.num_rows for b in run(iter(self.toArrow().to_batches()))) or self)
    match.tokens(df, "s", cut)
    assert len(sizes) > 20 and sum(sizes) == 200  # one batch came in
