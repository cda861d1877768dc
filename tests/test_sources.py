import os

from termloom.operators.dictionary import Dictionary, duplicates_report
from termloom.sources.csv import read_csv, write_csv
from termloom.sources.files import best_decoding, binary, column_catalog, data_files, manifest, scan_columns, text_records, without_outputs
from termloom.sources.layout import best_column, column_names, header_row
from termloom.sources.xlsx import SheetSource, Workbook, write_workbook


def test_names_and_headers():
    assert column_names(["a", None, "a", "a.1", " ", "a"]) == ["a", "Unnamed: 1", "a.1", "a.1.1", "Unnamed: 4", "a.2"]
    assert header_row([["年度报告一览"], [], ["公司代码", "日期", "内容"], ["1", "2024", "x"]])[0] == 2
    assert header_row([]) == (0, 0.0)
    assert best_column({"回复内容": 1, "提问内容": 3, "日期": 9}, ("正文", "内容")) == "提问内容"


def test_workbooks(spark, tmp_path):
    p = str(tmp_path / "in" / "b.xlsx")
    write_workbook(p, {"说明": (["随便"], []), "数据": (["", "一览"], [[], ["companyid", None, "日期", "内容"], ["000001", 3, "2024-03-15", "绿色发展"], ["2", None, 45292, "a<b&\x01"]])})
    with Workbook(p) as book:
        assert book.layout()[0] == "数据" and book.header() == ["companyid", "Unnamed: 1", "日期", "内容"]
    spark.dataSource.register(SheetSource)
    rows = spark.read.format("sheet").load(str(tmp_path / "in")).orderBy("__row").collect()
    assert [(r.companyid, r["日期"], r["内容"], r["__row"]) for r in rows] == [("000001", "2024-03-15", "绿色发展", 2), ("2", "45292", "a<b&", 3)]
    assert scan_columns([p], print)[1]["内容"] == 1


def test_dictionaries(spark, tmp_path):
    d = Dictionary({"环境": ["生态环境", "绿色"], "治理": ["绿色", "总计"], "年份": ["x"]})
    d.export(str(tmp_path / "d.xlsx"))
    e = Dictionary()
    e.import_file(str(tmp_path / "d.xlsx"))
    assert e.words("环境") == ["生态环境", "绿色"] and e.category_of()["绿色"] == "治理" and e.duplicates() == {"绿色": ["环境", "治理"]}
    clean, gone = e.without_reserved()
    assert clean.categories() == ["环境", "治理"] and set(gone) == {"年份", "x", "总计"}
    assert duplicates_report(e.to_df(spark)).collect()[0].effective == "治理"
    (tmp_path / "t.txt").write_text("# c\n环境：a,b；c d\n坏行\n治理: e", encoding="gb18030")
    f = Dictionary()
    f.import_file(str(tmp_path / "t.txt"))
    assert f.words("环境") == ["a", "b", "c", "d"] and f.words("治理") == ["e"] and f.total() == 5
    assert f.rename_category("环境", "新") and f.categories() == ["治理", "新"] and not f.rename_category("新", "治理")
    f.add_lines("新", "z\n\na")
    f.remove_words("新", "a", "b")
    assert f.words("新") == ["c", "d", "z"] and f.search("新", "Z") == ["z"]
    assert Dictionary.from_df(f.to_df(spark)).fingerprint() == f.fingerprint()


def test_text_and_csv(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "000001_2022_x.txt").write_text("正文\r\n第二行", encoding="utf-8")
    (folder / "600000 _abc.txt").write_bytes("简体中文内容".encode("gb18030"))
    (folder / "~$x.txt").write_text("no")
    files, counts, errors = data_files([str(folder)])
    assert len(files) == 2 and counts == {"d": 2} and not errors
    got = {r["公司代码"]: (r["年份"], r["文本内容"]) for r in text_records(spark, str(folder)).filter("`公司代码` <> '~$x.txt'").collect() if r["文本内容"] != "no"}
    assert got["000001"] == ("2022", "正文\n第二行") and got["600000"][1] == "简体中文内容"
    m = manifest(binary(spark, str(folder), "000001*")).collect()[0]
    assert m["指纹算法"] == "SHA256" and len(m["文件指纹"]) == 64
    assert best_decoding("年度报告 目录".encode("gb18030"))[1] == "gb18030"
    p = str(tmp_path / "c.csv")
    with open(p, "w", encoding="gb18030") as f:
        f.write('代码;文本\n1;"多\n行"\n2;NA\n')
    rows = read_csv(spark, p).collect()
    assert [(r["代码"], r["文本"], r["__row"]) for r in rows] == [("1", "多\n行", 2), ("2", None, 3)]
    write_csv(spark.createDataFrame([(1, None, "é")], "a int, b string, c string"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes() == "﻿a,b,c\r\n1,,é\r\n".encode()
    assert without_outputs([p, str(tmp_path / "r_csv" / "x.csv")], str(tmp_path / "r.xlsx")) == [p]
    assert column_catalog([["a", "b"], ["b"]]) == (["b", "a"], {"a": 1, "b": 2})
    assert os.path.exists(p)
