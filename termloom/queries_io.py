"""Registered queries of sources, sinks, file lists, settings and reports, each with its SQL twin.

What a query writes goes to a folder of its own below the checkpoint folder and
is read back by the matching source; the SQL says what must come back.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.functions import fields as D
from termloom.functions import text as T
from termloom.operators import match, panel, ratios, scoring
from termloom.operators.dictionary import Dictionary, read_tiered
from termloom.plans.analysis import lacking_roles, numbered, quality_preview
from termloom.queries import (
    CATEGORIES,
    COUNTS_SQL,
    DICT_SQL,
    DICTIONARY,
    FIRM_SQL,
    METRIC_SQL,
    SQL_CORPUS,
    SQL_HITS,
    SQL_REPORTS,
    SQL_SCORED,
    TERMS,
    _hits_for_scoring,
    _risk,
    _sentences_sql,
    _stub,
    _wide_sql,
    analysis,
    corpus,
    han,
    query,
    reports,
    scored,
    spec,
)
from termloom.session import checkpoint_dir, stage, table
from termloom.sources import files as S
from termloom.sources import sinks
from termloom.sources.csv import read_csv, write_csv
from termloom.sources.layout import best_column, column_names
from termloom.sources.xlsx import SheetSource, write_workbook
from termloom.streaming.files import merge_counts, parquet_stream, run_stream, signature


def folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; it goes when the application ends."""
    path = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    local = re.sub("^file:/+", "/", path)
    os.makedirs(local, exist_ok=True)
    return local


# --- text files ----------------------------------------------------------------

STEM = "lpad(cast(doc_id % 1000 as varchar), 6, '0') || '_' || (2000 + doc_id % 30) || '_' || doc_id"


def text_folder(spark: SparkSession, sf_dir: str) -> str:
    """Every document as a text file below a folder for its source."""
    d = table(spark, sf_dir, "documents")
    stem = F.concat_ws("_", F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"), (F.col("doc_id") % 30 + 2000).cast("string"), F.col("doc_id").cast("string"))
    root = folder(spark)
    sinks.write_texts(d.select(F.concat("source", F.lit("/"), stem, F.lit(".txt")).alias("relative"), F.col("text").alias("body")), root).count()
    return root


def _doc_id(path: str):
    return F.regexp_extract(path, r"_([0-9]+)\.txt$", 1).cast("long").alias("doc_id")


@query("K08_S06_F01_F05_text_files", f"select doc_id, lpad(cast(doc_id % 1000 as varchar), 6, '0') as code, regexp_extract({STEM}, '((?:19|20)[0-9]{{2}})', 1) as yr, sha256(text) as body, 2 as row_no from documents")
def text_files(spark, sf_dir):
    found = S.text_records(spark, text_folder(spark, sf_dir))
    return found.select(_doc_id("__file"), F.col("公司代码").alias("code"), F.col("年份").alias("yr"), F.sha2("文本内容", 256).alias("body"), F.col("__row").cast("int").alias("row_no"))


@query("H01_H03_S01_manifest", "select doc_id, cast(strlen(text) as bigint) as size, 'SHA256' as method, sha256(text) as fingerprint from documents")
def file_manifest(spark, sf_dir):
    found = S.manifest(S.binary(spark, text_folder(spark, sf_dir)))
    return found.select(_doc_id("输入文件"), F.col("文件大小(字节)").alias("size"), F.col("指纹算法").alias("method"), F.col("文件指纹").alias("fingerprint"))


@query("S01_A23_P08_directory_scan", "select source as place, count(*) as n from documents group by source")
def directory_scan(spark, sf_dir):
    root = text_folder(spark, sf_dir)
    own = os.path.join(root, "out_checkpoint")
    os.makedirs(own)
    for name in ("out.xlsx", "~$x.txt", ".hidden.txt", "out_checkpoint/a.txt"):
        open(os.path.join(root, name), "w").close()
    found, counts, _ = S.data_files([root])
    kept = S.without_outputs(found, os.path.join(root, "out.xlsx"))
    places = [k.split("/", 1)[1] for k in counts if "/" in k and not k.endswith("_checkpoint")]
    files = S.listed(spark, kept).withColumn("place", F.element_at(F.split("path", "/"), -2))
    return files.filter(F.col("place").isin(places)).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("S11_best_decoding", f"with {SQL_REPORTS} select doc_id, case when doc_id % 2 = 0 then 'utf-8' else 'gb18030' end as encoding, sha256('年度报告目录' || han_text) as body from reports")
def best_decoding(spark, sf_dir):
    def encode(batches):
        for b in batches:
            raw = [t.encode("utf-8" if i % 2 == 0 else "gb18030") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(raw, pa.binary())], ["path", "content"])

    raw = reports(spark, sf_dir).select("doc_id", F.concat(F.lit("年度报告目录"), "han_text")).mapInArrow(encode, "path string, content binary")
    found = S.decoded(raw, partial(S.best_decoding, prefer_utf8=True))
    return found.select(F.col("path").cast("long").alias("doc_id"), "encoding", F.sha2("text", 256).alias("body"))


@query("S12_lenient_utf8", "select doc_id, sha256(text || chr(10) || 'é') as body from documents")
def lenient_utf8(spark, sf_dir):
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF0D0AC3A9")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.lenient(raw), 256).alias("body"))


@query("P15_P16_batches", f"select '/' || {STEM} || '.txt' as path from documents order by path limit 50 offset 20")
def file_batches(spark, sf_dir):
    stem = F.concat_ws("_", F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"), (F.col("doc_id") % 30 + 2000).cast("string"), F.col("doc_id").cast("string"))
    return S.batch(table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), stem, F.lit(".txt")).alias("path")), 20, 50)


@query("O11_sampled_files", "select 'f' || doc_id as path from documents order by md5('42:f' || doc_id), path limit 20")
def sampled_files(spark, sf_dir):
    return S.sampled(table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")), 20)


@query("J11_C03_pending_files", "select 'f' || doc_id as path from documents where doc_id not in (select doc_id from labels)")
def pending_files(spark, sf_dir):
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    return S.pending(table(spark, sf_dir, "documents").select(path), table(spark, sf_dir, "labels").select(path))


@query("S07_head", "select o_orderkey as \"__row\", o_custkey from orders order by o_orderkey limit 500")
def first_rows(spark, sf_dir):
    return S.head(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("__row"), "o_custkey"), 500)


@query("P17_preview", "select cast(page_id as varchar) as \"__row\", coalesce(left(html, 200), '') as cell from pages order by page_id limit 100")
def preview(spark, sf_dir):
    return S.preview(table(spark, sf_dir, "pages").select(F.col("page_id").alias("__row"), F.col("html").alias("cell")))


@query("A22_tally", f"with {SQL_REPORTS} select count_if(yr > 0) as success, count_if(yr = 0) as failed from records")
def tally(spark, sf_dir):
    return S.tally(reports(spark, sf_dir).withColumn("status", F.when(D.year_of(F.col("raw_date")) > 0, "ok")), "status", "ok")


# --- tables in files -------------------------------------------------------------


@query("S02_S08_O08_K01_K02_sheets", "select cast(c_custkey as varchar) as code, c_name as name, cast(c_nationkey as varchar) as nation, case when c_custkey % 3 > 0 then left(c_mktsegment, 32767) end as segment, row_number() over (order by c_custkey) + 1 as row_no from customer")
def sheets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name", F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    body = [[], ["公司代码", "公司名称", "日期", "内容"]]
    path = f"{folder(spark)}/book.xlsx"
    write_workbook(path, {"说明": (["随便"], []), "数据": (["一览"], (r for part in (body, sinks.cells(c).toLocalIterator()) for r in part))})
    spark.dataSource.register(SheetSource)
    found = spark.read.format("sheet").load(path)
    return found.select(F.col("公司代码").alias("code"), F.col("公司名称").alias("name"), F.col("日期").alias("nation"), F.col("内容").alias("segment"), F.col("__row").alias("row_no"))


@query("K03_O09_overflow", "select s_suppkey, s_name from supplier order by s_suppkey")
def overflow(spark, sf_dir):
    """A sheet with more rows than fit is also written whole; here four fit."""
    path = f"{folder(spark)}/out.xlsx"
    extra = sinks.write_sheets(path, {"s": table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey")}, most=4)
    found = read_csv(spark, extra["s"])
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("S04_S05_P05_K04_csv", "select cast(doc_id as varchar) as doc_id, source, sha256(text) as body, row_number() over (order by doc_id) + 1 as row_no from documents")
def csv_round_trip(spark, sf_dir):
    path = f"{folder(spark)}/t.csv"
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "source", "text").orderBy("doc_id"), path)
    found = read_csv(spark, path)
    return found.select("doc_id", "source", F.sha2("text", 256).alias("body"), F.col("__row").alias("row_no"))


@query("S05_split_csv_rows", "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, row_number() over (order by o_orderkey) + 1 as row_no from orders")
def split_csv_rows(spark, sf_dir):
    path = f"{folder(spark)}/o.csv"
    write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), path)
    found = read_csv(spark, path)
    return found.select("o_orderkey", "o_custkey", F.col("__row").alias("row_no"))


@query("K06_S19_F26_stata", "select c_custkey, c_name, c_acctbal as c_acct_bal, cast(c_nationkey as integer) as c_nationkey from customer")
def stata(spark, sf_dir):
    path = f"{folder(spark)}/t.dta"
    sinks.write_stata(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("c_acct-bal"), "c_nationkey"), path, {"c_name": "n" * 99})
    found, _ = sinks.read_stata(spark, path)
    return found.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acct_bal", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("K07_F31_labels", "select * from (values (0, 'a_b', repeat('x', 80)), (1, 'c', 'y')) t(pos, variable, label)")
def label_rows(spark, sf_dir):
    path = f"{folder(spark)}/t.dta"
    sinks.write_stata(spark.createDataFrame([(1, 2)], "`a-b` int, c int"), path, {"a-b": "x" * 99, "c": "y"})
    return sinks.label_table(spark, sinks.read_stata(spark, path)[1])


@query("S09_S10_O10_catalog", "select * from (values (0, 'k', 3, false), (1, '回复内容', 2, true), (2, 'b', 1, false), (3, 'c', 1, false)) t(pos, name, n, best)")
def catalog(spark, sf_dir):
    root = folder(spark)
    write_workbook(f"{root}/1.xlsx", {"s": (["k", "回复内容"], [[1, "x"]])})
    for name, head in (("2.csv", "k,回复内容,b"), ("3.csv", "k,c")):
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(f"{head}\n1,2,3\n")
    names, n = S.scan_columns(sorted(f"{root}/{f}" for f in os.listdir(root)))
    return spark.createDataFrame([(i, c, n[c], c == best_column(n, ("正文", "内容"))) for i, c in enumerate(names)], "pos int, name string, n int, best boolean")


@query("F25_column_names", "select * from (values (0, 'a'), (1, 'Unnamed: 1'), (2, 'a.1'), (3, 'Unnamed: 3'), (4, 'a.2')) t(pos, name)")
def normal_names(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(column_names(["a", None, "a", " ", "a"]))), "pos int, name string")


@query(
    "S13_F09_structured_texts",
    "select doc_id, lpad(cast(doc_id % 1000 as varchar), 6, '0') as code, source as company, 'success' as status, case when doc_id % 4 > 0 then sha256(chr(10) || text) end as body from documents",
)
def structured_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    code = F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0")
    head = F.concat(F.lit("公司代码：x\n公司代码："), code, F.lit("\n公司名称： "), "source", F.lit(" \n提取状态：success\n"))
    parts = T.split_body(F.concat(head, F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(f"{T.BODY_MARKER}\n"), "text")).otherwise("")))
    df = d.select("doc_id", parts["head"].alias("head"), parts["body"].alias("body"))
    field = lambda n: T.header_field(F.col("head"), n)
    return df.select("doc_id", field("公司代码").alias("code"), field("公司名称").alias("company"), field("提取状态").alias("status"), F.sha2("body", 256).alias("body"))


# --- dictionaries ------------------------------------------------------------------


@query("S14_K09_dictionary_sheet", f"with {DICT_SQL} select cat_pos, category, kw_pos, keyword from d")
def dictionary_sheet(spark, sf_dir):
    path = f"{folder(spark)}/d.xlsx"
    DICTIONARY.export(path)
    back = Dictionary()
    back.import_file(path)
    return back.to_df(spark)


@query("S15_dictionary_text", "select * from (values (0, '环境', 0, 'a'), (0, '环境', 1, 'b'), (0, '环境', 2, 'c'), (1, '治理', 0, 'd:e')) t(cat_pos, category, kw_pos, keyword)")
def dictionary_text(spark, sf_dir):
    path = f"{folder(spark)}/d.txt"
    with open(path, "w", encoding="gb18030") as f:
        f.write("# 说明\n环境：a,b；c a\n坏行\n治理：d:e\n")
    d = Dictionary()
    d.import_file(path)
    return d.to_df(spark)


@query("S16_W07_tiered_terms", "select * from (values (0, 'x', 1, 'one', 'kw001'), (1, 'y', 2, 'two', 'kw002'), (2, 'x', 2, 'two', 'kw003')) t(pos, term, tier, tier_name, var)")
def tiered_terms(spark, sf_dir):
    path = f"{folder(spark)}/t.xlsx"
    write_workbook(path, {"词典": (["tier", "term", "tier_name"], [[1, " x ", "one"], [2, None, "two"], [2, "y", "two"], [2, "  ", "two"], [2, "x", "two"]])})
    return read_tiered(spark, path)


@query("S17_U04_J03_stopwords", "with t as (select doc_id, unnest(list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '')) as keyword from documents) select doc_id, keyword, count(*) as n from t where keyword in ('the', 'und') group by all")
def stopwords(spark, sf_dir):
    path = f"{folder(spark)}/s.txt"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("of\n\nque\n")
    d = match.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return match.token_hits(d, ["the", "of", "und", "que", "的"], ["doc_id"], match.load_stopwords(path))


@query("O06_keyword_order", f"with {DICT_SQL} select row_number() over (order by keyword) - 1 as pos, keyword from (select distinct keyword from d)")
def keyword_order(spark, sf_dir):
    return spark.createDataFrame([(i, w) for i, w in enumerate(DICTIONARY.keywords())], "pos long, keyword string")


# --- text functions ------------------------------------------------------------------


UNSPACED = "replace(han_text, ', ', ',')"


@query("F02_page_lines", f"with {SQL_REPORTS} select doc_id, unnest({_sentences_sql(UNSPACED)}) as sentence from reports")
def page_lines(spark, sf_dir):
    """Page numbers and running heads between the parts of sentences leave no trace."""
    broken = F.replace("han_text", F.lit(", "), F.lit(",\n\n 12 \n某公司2020年度报告全文\n第 3 页 / 9\n"))
    return reports(spark, sf_dir).select("doc_id", F.explode(T.sentences(broken)).alias("sentence"))


@query("F03_inline_heads", f"with {SQL_REPORTS} select doc_id, unnest({_sentences_sql('han_text')}) as sentence from reports")
def inline_heads(spark, sf_dir):
    broken = F.replace("han_text", F.lit(", "), F.lit(", 甲乙丙丁股份有限公司 2021 年 年度报告全文"))
    return reports(spark, sf_dir).select("doc_id", F.explode(T.sentences(broken)).alias("sentence"))


@query("F07_F17_compact", f"with {SQL_REPORTS} select doc_id, unnest(list_transform({_sentences_sql('han_text')}, lambda s: trim(regexp_replace(s, '[\\s\\x{{85}}\\x{{A0}}\\x{{3000}}]', '', 'g'), '；;：:，,、 　'))) as sentence from reports")
def compact(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("han_text"), compact=True)).alias("sentence"))


@query("D06_D08_numbers", "select o_orderkey, case when o_orderkey % 3 = 0 then null else o_totalprice end as n, round(case when o_custkey % 7 > 0 then o_custkey % 5 / (o_custkey % 7) * 100 else 0.0 end, 2) as pct from orders")
def numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cell = F.when(F.col("o_orderkey") % 3 == 0, "n.a.").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit(" ")))
    return o.select("o_orderkey", D.number(cell).alias("n"), D.percent(F.col("o_custkey") % 5, F.col("o_custkey") % 7).alias("pct"))


# --- analysis reports ------------------------------------------------------------------


@query(
    "P01_P03_P14_derived",
    f"with {SQL_REPORTS} select doc_id, code, yr, mon, shown, sha256(source || chr(10) || chr(10) || han_text) as body, source as file, doc_id + 2 as row_no from records",
)
def derived(spark, sf_dir):
    from dataclasses import replace

    a = analysis(spark, sf_dir)
    a.spec = replace(a.spec, texts=("source", "han_text", "absent"))
    d = a.derived
    return d.select("doc_id", F.col("_stkcd").alias("code"), F.col("_year").alias("yr"), F.col("_month").alias("mon"), F.col("_date").alias("shown"), F.sha2("_text", 256).alias("body"), F.col("_source_file").alias("file"), F.col("_source_row").alias("row_no"))


@query("O01_main_order", _wide_sql("code, yr", "valid", "true").replace("select * from w", "select row_number() over (order by code, yr) as no, code, yr, total from w"))
def main_order(spark, sf_dir):
    main = analysis(spark, sf_dir, "yearly").sheets()["公司年份分类统计"]
    return numbered(main, "公司代码", "年份").select(F.col("序号").cast("long").alias("no"), F.col("公司代码").alias("code"), F.col("年份").alias("yr"), F.col("总计").alias("total"))


@query("O02_P12_detail_order", f"with {SQL_HITS}, g as (select code, yr, category, keyword, cast(sum(n) as bigint) as n from found group by all) select row_number() over (order by code, yr, category, keyword) as no, code, yr, category, keyword, n from g")
def detail_order(spark, sf_dir):
    detail = analysis(spark, sf_dir, "yearly").sheets()["关键词明细"]
    rows = numbered(detail, "公司代码", "年份", "分类", "关键词")
    return rows.select(F.col("序号").cast("long").alias("no"), F.col("公司代码").alias("code"), F.col("年份").alias("yr"), F.col("分类").alias("category"), F.col("关键词").alias("keyword"), F.col("次数").alias("n"))


@query(
    "A24_sample_quality",
    f"""with {SQL_REPORTS}, picked as (select *, row_number() over (partition by source order by doc_id) as i from records where source in (select distinct source from records order by source limit 7)),
    opening as (select * from picked where i <= 9), per as (select source as f, {COUNTS_SQL} from opening group by source)
    select f as file, cast(raw_rows as bigint) as raw_rows, cast(valid_rows as bigint) as valid_rows, cast(no_code as bigint) as no_code, cast(no_month as bigint) as no_month from per
    union all select '合计', cast(sum(raw_rows) as bigint), cast(sum(valid_rows) as bigint), cast(sum(no_code) as bigint), cast(sum(no_month) as bigint) from per""",
)
def sample_quality(spark, sf_dir):
    q = quality_preview(reports(spark, sf_dir).withColumn("row", F.col("doc_id") + 2), DICTIONARY, spec(), 7, 9)
    return q.select(F.col("文件").alias("file"), F.col("原始行数").alias("raw_rows"), F.col("有效记录数").alias("valid_rows"), F.col("公司代码为空").alias("no_code"), F.col("月份无法识别").alias("no_month"))


@query("A25_P02_lacking_roles", "select * from (values ('b', '缺少公司代码列：raw_code'), ('c', '缺少日期列：raw_date'), ('d', '缺少已选择的文本列')) t(path, status)")
def roles(spark, sf_dir):
    headers = {"a": ["raw_code", "raw_date", "han_text"], "b": ["x"], "c": ["raw_code"], "d": ["raw_code", "raw_date"]}
    return spark.createDataFrame(sorted(lacking_roles(headers, spec()).items()), "path string, status string")


@query("H07_metadata", f"select * from (values ('统计方式', 'monthly'), ('公司代码列', 'raw_code'), ('日期列', 'raw_date'), ('文本列', 'han_text'), ('句子最大长度', '200'), ('分类数', '{len(CATEGORIES)}'), ('关键词数', '{len(DICTIONARY.keywords())}')) t(item, value)")
def metadata(spark, sf_dir):
    rows = analysis(spark, sf_dir, "monthly").metadata.toDF("item", "value")
    return rows.filter(F.col("item").isin("统计方式", "公司代码列", "日期列", "文本列", "句子最大长度", "分类数", "关键词数"))


@query("streaming_analysis", f"with {SQL_HITS} select code, yr, keyword, cast(sum(n) as bigint) as n from found group by all")
def streaming_analysis(spark, sf_dir):
    """The reports as a file stream, analysed batch by batch; the counts of all batches are merged."""
    base = folder(spark)
    reports(spark, sf_dir).withColumn("row", F.col("doc_id") + 2).repartition(6).write.parquet(f"{base}/in")
    stream = parquet_stream(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema, 2)
    run_stream(stream, DICTIONARY, spec("yearly"), lambda a, i: a.counts.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/checkpoint").awaitTermination()
    return merge_counts(spark.read.parquet(f"{base}/out"), ["公司代码", "年份"]).toDF("code", "yr", "keyword", "n")


# --- panels --------------------------------------------------------------------------


@query("P09_report_names", "select doc_id, lpad(cast(doc_id % 50 + 1 as varchar), 6, '0') as code, cast(doc_id % 5 + 2018 as integer) as yr from documents where doc_id % 4 = 0")
def report_names(spark, sf_dir):
    k = F.col("doc_id") % 4
    code, year = F.lpad((F.col("doc_id") % 50 + 1).cast("string"), 6, "0"), (F.col("doc_id") % 5 + 2018).cast("string")
    stem = F.when(k == 0, F.concat_ws("_", code, year, F.col("doc_id").cast("string"))).when(k == 1, F.concat_ws("_", F.substring(code, 2, 5), year, F.lit("0"))).when(k == 2, F.concat_ws("_", code, F.lit("1799"), F.lit("0"))).otherwise(F.concat_ws("_", code, year, F.lit("0")))
    body = F.when(k < 3, F.concat(F.lit(T.BODY_MARKER), "text")).otherwise(F.col("text"))
    cut = panel.report_sentences(table(spark, sf_dir, "documents").select(stem.alias("stem"), body.alias("text")))
    return cut.select(F.element_at(F.split("stem", "_"), 3).cast("long").alias("doc_id"), F.col("公司代码").alias("code"), F.col("年份").alias("yr"))


@query("P10_P11_A17_scored_rows", f"with {SQL_SCORED} select code, yr, term, sentence, cast(phys as integer) as phys, cast(trans as integer) as trans, cast(tone as integer) as tone, occ from sc")
def scored_rows(spark, sf_dir):
    r = panel.scored_rows(scored(spark, sf_dir))
    return r.select("code", F.col("year").alias("yr"), F.col("keyword").alias("term"), "sentence", "phys", "trans", "tone", "occ")


@query("P13_probe", f"with {SQL_CORPUS} select doc_id, term, cast(sum(n) as bigint) as n from cf group by all")
def probe(spark, sf_dir):
    cut, _, terms = corpus(spark, sf_dir)
    found = panel.term_hits(cut, terms, probe=True)
    return found.groupBy(F.element_at(F.split("stem", "_"), 3).cast("long").alias("doc_id"), "term").agg(F.sum("n").alias("n"))


HIT_TERMS = [(han(t), n) for t, n, _ in TERMS if t != "zzzz"]
PANEL_SQL = f"""{SQL_CORPUS}, per as (select doc_id, {", ".join(f"cast(sum(n) filter (term = '{t}') as bigint) as \"{t}\"" for t, _ in HIT_TERMS)} from cf group by doc_id),
  wide as (select code as "公司代码", yr as "年份", len(sents) as mda_sent, {", ".join(f"coalesce(\"{t}\", 0) as \"{t}\"" for t, _ in HIT_TERMS)} from ccut left join per using (doc_id)),
  summed as (select *, {" + ".join(f'"{t}"' for t, _ in HIT_TERMS)} as total_freq, {", ".join(" + ".join(f'"{t}"' for t, k in HIT_TERMS if k == tier) + f" as t{tier}_freq" for tier in (1, 2, 3))} from wide),
  panel as (select * replace (cast(mda_sent as integer) as mda_sent), {", ".join(f"case when mda_sent > 0 then {c}_freq / mda_sent end as {c}_ratio" for c in ("total", "t1", "t2", "t3"))} from summed)"""


@query("A13_U06_O05_keyword_panel", f"with {PANEL_SQL} select * from panel")
def keyword_panel(spark, sf_dir):
    return panel.keyword_panel(*corpus(spark, sf_dir))


_METRICS = re.findall(r" as ([a-z_]+)(?:,|$)", METRIC_SQL)
_VARS = [f"kw{i + 1:03d}" for i in range(len(TERMS))]


@query(
    "A18_J05_J06_score_panel",
    f"""with {PANEL_SQL}, {SQL_SCORED[len(SQL_CORPUS) + 2 :]}, firm as (select code, yr, {FIRM_SQL} from sc group by code, yr),
    m as (select code, yr, 'kw' || lpad(cast(pos + 1 as varchar), 3, '0') as var, {METRIC_SQL} from sc join terms using (term) group by code, yr, pos),
    k as (select code, yr, {", ".join(f"max({n}) filter (var = '{v}') as {v}_{n}" for n in _METRICS for v in _VARS)} from m group by code, yr)
    select p."公司代码" as code, p."年份" as year, p.mda_sent, cast(p.total_freq as integer) as total_freq, p.total_ratio,
      {", ".join(f"cast(coalesce(firm.{c}, 0) as integer) as {c}" for c in re.findall(r" as ([a-z_]+)(?:,|$)", FIRM_SQL))}, {", ".join(f"cast(coalesce(k.{v}_{n}, 0) as integer) as {v}_{n}" for n in _METRICS for v in _VARS)}
    from panel p left join firm on p."公司代码" = firm.code and p."年份" = firm.yr left join k on p."公司代码" = k.code and p."年份" = k.yr""",
)
def score_panel(spark, sf_dir):
    cut, _, terms = corpus(spark, sf_dir)
    cut = stage(cut, "zstd")  # cutting sentences is most of the work; all parts read them here
    return panel.score_panel(panel.keyword_panel(cut, panel.term_hits(cut, terms), terms), scored(spark, sf_dir, cut), terms, filled=True)


@query("S20_sentence_panel", "select coalesce(case when c_custkey % 13 > 0 then lpad(cast(c_custkey as varchar), cast(greatest(6, length(cast(c_custkey as varchar))) as integer), '0') end, '00<NA>') as stkcd_key, cast(1992 + c_custkey % 7 as varchar) as year_key, c_name as mda_company_name, case when c_custkey % 5 > 0 then cast(c_custkey % 9 as double) end as mda_sentence_count from customer")
def sentence_panel(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.when(k % 13 > 0, k).alias("公司代码"), (k % 7 + 1992).alias("年份"), F.col("c_name").alias("公司名称"), F.lit("success").alias("提取状态"),
        F.when(k % 5 > 0, (k % 9).cast("string")).otherwise("?").alias("句子数"), F.lit("1").alias("原始句子数"), F.lit("x").alias("疑似表格段落数"),
    )
    path = f"{folder(spark)}/p.csv"
    write_csv(c, path)
    return ratios.sentence_panel(read_csv(spark, path)).select("stkcd_key", "year_key", "mda_company_name", "mda_sentence_count")


@query("K13_issues", "select o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 13 > 0 and c_custkey % 7 = o_orderkey % 7 and c_custkey % 5 > 0 and c_custkey % 4 > 0 and c_custkey % 3 > 0) and o_orderkey % 17 > 0")
def ratio_issues(spark, sf_dir):
    return ratios.issues(_risk(spark, sf_dir)).filter("stkcd is not null").select("o_orderkey")


# --- scoring --------------------------------------------------------------------------

_STRIP = r"regexp_replace(coalesce({}, ''), '^[\s\x{{85}}\x{{A0}}\x{{3000}}]+|[\s\x{{85}}\x{{A0}}\x{{3000}}]+$', '', 'g')"
_TEXT, _ROLE = _STRIP.format("text"), _STRIP.format("role")


@query(
    "F30_prompts",
    f"""select conv_id * 1000 + turn as pos, '请分析下列中文年报句子，并按给定 JSON 结构返回结果。' || chr(10) || '目标关键词：' || case when {_ROLE} = '' then '未提供' else {_ROLE} end || chr(10) || '关键词分类：分类' || chr(10) || '句子：'
    || case when length({_TEXT}) > 500 then left({_TEXT}, 500) || '…（已截断）' else {_TEXT} end || chr(10) || chr(10) || '只返回 JSON，不要输出任何额外文字。' as prompt from conversations""",
)
def prompts(spark, sf_dir):
    return _hits_for_scoring(spark, sf_dir).select("pos", scoring.prompt_text().alias("prompt"))


_DUAL = {**scoring.DUAL, **scoring.FIELDS}


@query(
    "L09_J10_dual_scoring_with_cache",
    f"""with h as (select conv_id * 1000 + turn as pos, role, {_TEXT} as t, text from conversations where text is not null and role is not null), u as (select role, t, first(text order by pos) as text from h group by role, t)
    select h.pos, h.role as "命中关键词", '分类' as "分类", {", ".join(f'cast(length(u.text) % {size} as integer) as "{c}"' for c, size, _ in _DUAL.values())}, '成功' as "LLM分析状态", '' as "LLM分析错误" from h join u using (role, t)""",
)
def dual_scoring(spark, sf_dir):
    s = scoring.Scoring(dual=True)
    rows = _hits_for_scoring(spark, sf_dir).filter("`命中句子` is not null and `命中关键词` is not null")
    _, cache = scoring.score_hits(rows.filter("`命中关键词` = 'user'"), _stub(s), s, "pos")
    return scoring.score_hits(rows, _stub(s), s, "pos", stage(cache))[0].drop("命中句子")


@query("K11_L10_year_shards", "select conv_id * 1000 + turn as pos, case when turn % 3 > 0 then cast(2020 + turn % 3 as integer) end as yr, role from conversations")
def year_shards(spark, sf_dir):
    path = f"{folder(spark)}/years"
    rows = _hits_for_scoring(spark, sf_dir).withColumn("年份", F.when(F.col("pos") % 1000 % 3 > 0, F.col("pos") % 1000 % 3 + 2020).cast("int"))
    for part in (rows, rows.filter("`年份` = 2021"), rows.filter("`年份` is null")):  # years written again replace themselves
        scoring.by_year(part.select("pos", "年份", F.col("命中关键词").alias("role")), path)
    return spark.read.parquet(path).select("pos", F.col("年份").alias("yr"), "role")


@query("L08_K12_cache", f"select 'k' || conv_id as key, cast(max(turn) as integer) as rel, '{scoring.OK}' as status from conversations group by conv_id")
def cache_round_trip(spark, sf_dir):
    s = scoring.Scoring()
    path = f"{folder(spark)}/c.db"
    c = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("key")).agg(F.max("turn").cast("int").alias("turn"))
    columns = [f for f, _, _ in s.fields.values()]
    held = c.select("key", *[F.col("turn").alias(f) for f in columns], F.lit(scoring.OK).alias(scoring.STATUS), F.lit("").alias(scoring.ERROR))
    scoring.save_cache(held.withColumn(columns[0], F.lit(0)), path)
    scoring.save_cache(held, path)
    return scoring.load_cache(spark, path, s).select("key", F.col(columns[0]).alias("rel"), F.col(scoring.STATUS).alias("status"))


@query("S18_L11_resumed_hits", "select role as \"命中关键词\", text as \"命中句子\", case when turn % 2 = 0 then 0 else 2021 end as \"年份\" from conversations")
def resumed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("turn").alias("序号"), F.col("role").alias("命中关键词"), F.col("text").alias("命中句子"), F.when(F.col("turn") % 2 == 0, "x").otherwise("2021.0").alias("年份"), F.lit(1).alias("LLM相关性"))
    return scoring.resumed_hits(rows)


@query("L04_retries", "select * from (values (0, '{\"a\": 1}', '', 0), (1, null, 'boom', 1), (2, '{\"a\": 1}', '', 3), (3, null, '429', 40)) t(i, reply, error, waits)")
def retries(spark, sf_dir):
    out = []
    for i, fails in enumerate(([], ["boom"] * 9, ["429", "x 429", "rate limit"], ["429"] * 99)):
        waits: list[float] = []
        left = list(fails)

        def scorer(prompt, left=left):
            if left:
                raise RuntimeError(left.pop(0))
            return '{"a": 1}'

        out.append((i, *scoring.ask(scorer, "p", 2, waits.append), len(waits)))
    return spark.createDataFrame(out, "i int, reply string, error string, waits int")


@query("L05_L06_L12_H06_L01_D10_settings", "select * from (values ('cost', '1,000–2,500'), ('cost_open', 'unbounded'), ('key', 'm|' || left(sha1('p'), 8)), ('key_plain', 'm'), ('least', '2'), ('most', '7'), ('terminal', '-1 已取消')) t(item, value)")
def settings(spark, sf_dir):
    s = scoring.Scoring.from_inputs({"model": "", "max_sentences": "7", "prompt": "p"}, {"LLM_MODEL": "m"})
    end = spark.range(1).select(*scoring.terminal(scoring.Scoring(), scoring.CANCELLED, "")).first()
    rows = [
        ("cost", scoring.cost_estimate(5)), ("cost_open", scoring.cost_estimate(0)), ("key", s.model_key), ("key_plain", scoring.Scoring("m").model_key), ("least", str(scoring.at_least("0", 1, 2))),
        ("most", str(s.most)), ("terminal", f"{end['LLM相关性']} {end[scoring.STATUS]}"),
    ]
    return spark.createDataFrame(rows, "item string, value string")


@query("F28_missing_fields", "select i, case when i = 0 then '' else 'LLM返回了空响应或格式不符合预期（缺少字段：conf, rel）' end as error from (values (0), (1)) t(i)")
def missing_fields(spark, sf_dir):
    full = dict.fromkeys(scoring.FIELDS, 1)
    given = [(0, json.dumps(full)), (1, json.dumps({k: v for k, v in full.items() if k not in ("rel", "conf")}))]
    made = scoring.result_columns(F.col("r"), scoring.Scoring())
    return spark.createDataFrame(given, "i int, r string").select("i", made[scoring.ERROR].alias("error"))


@query("H04_K10_signature", "select sha1('[[[\"a\", 1, 2.0], [\"b\", 3, 4.0]], {\"mode\": \"raw\", \"x\": [1]}]') as signature")
def run_signature(spark, sf_dir):
    return spark.createDataFrame([(signature([("b", 3, 4.0), ("a", 1, 2.0)], {"x": [1], "mode": "raw"}),)], "signature string")
