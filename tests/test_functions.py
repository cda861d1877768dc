import random
import re

from pyspark.sql import functions as F

from termloom.functions import fields, text


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_years_months(spark):
    dates = ["2024-03-15", "2024年3月15日", "45292", "2011年", "2009", "x"]
    assert column(spark, dates, fields.year_of) == [2024, 2024, 2024, 2011, 2009, 0]
    assert column(spark, dates, fields.month_of) == [3, 3, 1, 0, 0, 0]
    assert column(spark, ["2024/4/1-2024/5/1", "2024年12月", "20240315", None, "5/6/2024", "March 2024", "2023-12-31T23:30:00-05:00"], fields.month_of) == [4, 12, 0, 0, 5, 3, 1]
    assert column(spark, ["45292", " 2024年 ", None], fields.date_text) == ["2024-01-01", "2024年", ""]


def test_codes(spark):
    given = ["1.SZ", "600001.sh", "12.7", "-5", "nan", "1234567", "", None, "AB", " 2 ", "12d"]
    assert column(spark, given, fields.stock_code) == ["000001", "600001", "000012", "-00005", "nan", "1234567", "", "", "AB", "000002", "12d"]
    assert column(spark, ["2", None, "x"], fields.code_key) == ["000002", "00<NA>", "00<NA>"]


def pack(seg, most):
    """Brute-force twin of the resplit rule, level by level."""
    segs = [seg]
    for d in "；;，,":
        out = []
        for s in segs:
            if len(s) <= most or d not in s:
                out.append(s)
                continue
            line = []
            for piece in s.split(d):
                if line and line[-1] and len(line[-1]) + 1 + len(piece) <= most:
                    line[-1] += d + piece
                elif line and not line[-1]:
                    line[-1] = piece
                else:
                    line.append(piece)
            out += [x for x in line if x]
        segs = out
    return [s[i : i + most] for s in segs for i in range(0, len(s), most)]


def test_resplit(spark):
    rng = random.Random(1)
    given = ["".join(rng.choice("ab，,;；") if rng.random() < 0.4 else "x" for _ in range(rng.randint(1, 60))) for _ in range(150)]
    assert column(spark, given, lambda c: text.resplit(F.array(c), 10)) == [pack(g, 10) for g in given]


def test_sentences(spark):
    han = "生态环境保护工作持续推进中"
    given = [
        f"{han}。\r\n \n{han}的第二句！短句。",
        "绿色发展战略规\n \n35 \n \n划署稳步实施完成。",
        f"{han}\n某某股份有限公司 2021 年年度报告全文\n继续推进",
        "12,345 | 67.8% | 9,000 | 12,345。" + han,
        han[:6] + "\n" + han[6:] + "\0。",
        None,
        "no han text in this sentence at all. None.",
    ]
    assert column(spark, given, text.sentences) == [[han, han + "的第二句"], ["绿色发展战略规划署稳步实施完成"], [han + "继续推进"], [han], [han], [], []]
    assert column(spark, given[-1:], lambda c: text.sentences(c, drop_tables=False)) == [["no han text in this sentence at all. None."]]
    assert column(spark, ["生 态；环 境保护工作持续推进中，"], lambda c: text.sentences(c, compact=True)) == [["生态；环境保护工作持续推进中"]]
    assert re.search(r"\\x\{B2\}-\\x\{B3\}", text.digit_class())


def test_counts(spark):
    assert column(spark, ["AAAA a.b A.B ab", "", None], lambda c: text.occurrences(c, F.lit("aa"))) == [2, 0, None]


def test_paragraphs(spark):
    body = "这是一个完整的句子，它以句号结尾。\n第二行也在这里\n\n单位：万元 项目\n\n12 345\n\n短的一行\n\n这一段没有任何标点符号但是它的长度足够长所以应当保留下来不被当成表格处理掉\n\n35"
    got = column(spark, [body], text.paragraphs)[0]
    assert got.text.startswith("这是一个完整的句子") and "万元" not in got.text and "足够长" in got.text and got.dropped == 3


def test_names(spark):
    got = column(spark, ["600276_2022_甲_甲2022年年度报告_2023-04-21", "000001_乙_2025", "002019_2022_丙"], fields.report_meta)
    assert [tuple(r) for r in got] == [("600276", "2022", "甲", "甲2022年年度报告", "2023-04-21"), ("000001", "2025", "乙", "乙2025年年度报告", ""), ("002019", "2022", "丙", "", "")]
    assert [tuple(r) for r in column(spark, ["002019_2022", "abc-2020"], fields.stem_meta)] == [("002019", "2019"), ("abc", "2020")]
