"""The core analysis: records in, panel, keyword detail, summary, quality, issues and hits out.

All results are lazy relations over one derived frame.  Counts stay long
(record, keyword, n); wide columns are made at the end, with the categories of
the dictionary as explicit pivot values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.fields import date_from, date_parts, date_text, month_from, percent, stock_code, year_from
from termloom.functions.text import sentences, strip
from termloom.operators.dictionary import RESERVED, Dictionary, duplicates_report
from termloom.operators.match import explode_sentences, hits, tokens

MODES = ("raw", "monthly", "yearly")
#: Issue rows kept a chunk, a file and a run; the report is a sample by design.
ISSUES_A_CHUNK, ISSUES_A_FILE, ISSUES_A_RUN = 250, 10_000, 10_000
CHUNK_ROWS = 10_000
MAX_SHEET_ROWS = 1_048_575
REASONS = ("公司代码为空", "年份无法识别", "月份无法识别", "文本为空")
COUNTERS = ("原始行数", "有效记录数", "进入统计记录数", "公司代码为空", "年份无法识别", "月份无法识别", "文本为空", "关键词命中次数")
OK = "成功"
MASKS = ("_valid", "_used", "_m1", "_m2", "_m3", "_m4")
#: Columns that hold the parts of a date while it is read.
PARTS = ("__date_number", "__date_text", "__date_moment")


@dataclass(frozen=True)
class Spec:
    """What to analyse: the roles of the columns and the mode."""

    code: str
    date: str
    texts: tuple[str, ...]
    mode: str = "raw"
    retained: tuple[str, ...] = ()
    share: bool = False
    tokens: bool = False
    stopwords: frozenset[str] | None = None
    tokenizer: object = None
    drop_tables: bool = True
    max_len: int = 200
    source_file: str = "__file"
    source_row: str = "__row"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")

    @property
    def keys(self) -> list[str]:
        return {"raw": ["公司代码", "年份", "月份", "日期", "来源文件", "源文件行号"], "monthly": ["公司代码", "年份", "月份"], "yearly": ["公司代码", "年份"]}[self.mode]


def missing_role(columns: list[str], spec: Spec) -> str | None:
    """The status of a file that lacks a role, else None."""
    if spec.code not in columns:
        return f"缺少公司代码列：{spec.code}"
    if spec.date not in columns:
        return f"缺少日期列：{spec.date}"
    if not any(t in columns for t in spec.texts):
        return "缺少已选择的文本列"
    return None


def lacking_roles(headers: dict[str, list[str]], spec: Spec) -> dict[str, str]:
    """The files that lack a role, each with its status; they are skipped and listed, the others go on."""
    found = {path: missing_role(columns, spec) for path, columns in headers.items()}
    return {path: status for path, status in found.items() if status}


def quality_preview(records: DataFrame, dictionary: Dictionary, spec: Spec, files: int = 100, rows: int = 500) -> DataFrame:
    """Quality of the first ``rows`` rows of the first ``files`` files: a look before a run, not its result."""
    file, row = F.col(spec.source_file), F.col(spec.source_row)
    some = records.select(file.alias("f")).distinct().orderBy("f").limit(files)
    first = records.join(F.broadcast(some), file == F.col("f"), "left_semi")
    first = first.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(row))).filter(F.col("__n") <= rows).drop("__n")
    return Analysis(first, dictionary, spec).quality


def joined_text(columns: list[Column]) -> Column:
    """Text columns with a paragraph break between, so that no word grows across two columns."""
    return F.concat_ws("\n\n", *[F.coalesce(c, F.lit("")) for c in columns])


@dataclass
class Analysis:
    """Lazy results of one run over ``records``, an all-text frame with source file and row."""

    records: DataFrame
    dictionary: Dictionary
    spec: Spec
    statuses: dict[str, str] = field(default_factory=dict)
    manifest: DataFrame | None = None
    _facts: DataFrame | None = None

    def __post_init__(self):
        problem = missing_role(self.records.columns, self.spec)
        if problem:
            raise ValueError(problem)
        self.dictionary, self.reserved = self.dictionary.without_reserved(RESERVED)
        self.spark: SparkSession = self.records.sparkSession
        self.word_list = self.dictionary.keywords()

    @property
    def derived(self) -> DataFrame:
        """Records with the derived roles and the masks."""
        s = self.spec
        texts = [F.col(f"`{t}`") for t in s.texts if t in self.records.columns]
        code, date = F.col(f"`{s.code}`"), F.col(f"`{s.date}`")
        n, text, at = (F.col(c) for c in PARTS)
        roles = F.struct(
            stock_code(code).alias("_stkcd"),
            year_from(n, text, at).alias("_year"),
            month_from(n, text, at).alias("_month"),
            date_from(n, text).alias("_date"),
            (F.col(s.source_file) if s.source_file in self.records.columns else F.lit("")).alias("_source_file"),
            (F.col(s.source_row).cast("long") if s.source_row in self.records.columns else F.lit(None).cast("long")).alias("_source_row"),
            joined_text(texts).alias("_text"),
        )
        # generators, so that dates are read once and the roles made once, and not again in every filter on them
        given = [F.col(f"`{c}`") for c in self.records.columns]
        df = self.records.select(*given, F.inline(F.array(date_parts(date))).alias(*PARTS)).select(*given, F.inline(F.array(roles)))
        blank = strip(F.col("_stkcd")) == ""
        valid = ~blank & (F.col("_year") > 0)
        df = df.withColumns({"_m1": blank, "_m2": ~blank & (F.col("_year") == 0), "_valid": valid})
        df = df.withColumns({"_m3": valid & (F.col("_month") == 0), "_m4": valid & (strip(F.col("_text")) == "")})
        return df.withColumn("_used", valid & (F.col("_month") > 0) if s.mode == "monthly" else valid)

    @property
    def _ids(self) -> list[str]:
        retained = [c for c in dict.fromkeys(self.spec.retained) if c in self.records.columns and c not in {self.spec.code, self.spec.date, *self.word_list} and not c.startswith("_")]
        return self.spec.keys + (retained if self.spec.mode == "raw" else [])

    @property
    def used(self) -> DataFrame:
        """The records that count, named as in the results."""
        month = F.when(F.col("_month") > 0, F.col("_month"))
        named = self.derived.filter("_used").withColumns(
            {"公司代码": F.col("_stkcd"), "年份": F.col("_year"), "月份": month, "日期": F.col("_date"), "来源文件": F.col("_source_file"), "源文件行号": F.col("_source_row")}
        )
        return named.select(*dict.fromkeys([*self._ids, "月份", "日期", "来源文件", "源文件行号", "_text"]))

    @property
    def sentence_rows(self) -> DataFrame:
        cut = self.used.withColumn("sentences", sentences(F.col("_text"), self.spec.max_len, self.spec.drop_tables)).drop("_text")
        return explode_sentences(cut)

    @property
    def sentence_hits(self) -> DataFrame:
        """A row for each keyword in each sentence, with its count."""
        return hits(self.sentence_rows, self.word_list)

    def _tokens(self, df: DataFrame) -> DataFrame:
        cut = df.withColumn("_text", F.array_join(sentences(F.col("_text"), self.spec.max_len, self.spec.drop_tables), "\n"))
        return tokens(cut, "_text", self.spec.tokenizer)

    @property
    def counts(self) -> DataFrame:
        """The ids, keyword, n > 0."""
        each = self.facts.filter("_used").select(*self._ids, F.inline("found"))
        return each.groupBy(*self._ids, "keyword").agg(F.sum("n").alias("n"))

    @property
    def categories(self) -> DataFrame:
        return F.broadcast(self.dictionary.effective(self.spark))

    @property
    def by_category(self) -> DataFrame:
        return self.counts.join(self.categories, "keyword", "left").withColumn("category", F.coalesce("category", F.lit("")))

    def _found(self, df: DataFrame, used: Column) -> DataFrame:
        """The rows of ``df`` with keyword and n: one for each keyword found in each sentence or token, and one at least."""
        text = F.when(used, F.col("_text"))
        if self.spec.tokens:
            stop = list(self.spec.stopwords or ())
            cut = self._tokens(df.withColumn("_text", text)).withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(stop)) if stop else F.col("tokens"))
            each = cut.drop("_text").select("*", F.explode_outer("tokens").alias("keyword")).drop("tokens")
            return each.join(self.categories.select("keyword", F.lit(1).cast("long").alias("n")), "keyword", "left").na.fill(0, ["n"])
        cut = df.withColumn("sentences", sentences(text, self.spec.max_len, self.spec.drop_tables)).drop("_text")
        return hits(cut.select("*", F.explode_outer("sentences").alias("sentence")).drop("sentences"), self.word_list, keep=True).drop("sentence")

    @property
    def facts(self) -> DataFrame:
        """One row for each record: its ids, masks, and ``found``, the keywords in it with their counts.

        The texts are read here and nowhere else; panel, detail, summary and
        quality are aggregates of this table, which ``hold`` keeps.
        """
        if self._facts is not None:
            return self._facts
        month = F.when(F.col("_month") > 0, F.col("_month"))
        named = {"公司代码": F.col("_stkcd"), "年份": F.col("_year"), "月份": month, "日期": F.col("_date"), "来源文件": F.col("_source_file"), "源文件行号": F.col("_source_row")}
        columns = list(dict.fromkeys([*self._ids, *named]))
        rows = self.derived.withColumns(named).select(F.monotonically_increasing_id().alias("_record"), *columns, *MASKS, "_text")
        each = self._found(rows, F.col("_used")).groupBy("_record", *columns, *MASKS, "keyword").agg(F.sum("n").alias("n"))
        one = F.when(F.col("n") > 0, F.struct("keyword", "n"))
        return each.groupBy("_record", *columns, *MASKS).agg(F.collect_list(one).alias("found"))

    def hold(self, facts: DataFrame | None = None) -> Analysis:
        """This run with its facts written down (or those given), so that no result reads the texts again."""
        from termloom.session import stage

        self._facts = stage(self.facts) if facts is None else facts
        return self

    @property
    def main(self) -> DataFrame:
        """One row for each record, month or year with a column for each category, the total and, if asked for, shares."""
        ids, cats = self._ids, self.dictionary.categories()
        record = ["_record"] if self.spec.mode == "raw" else []
        each = self.facts.filter("_used").select(*record, *ids, F.explode_outer("found").alias("f")).select(*record, *ids, "f.*")
        found = each.join(self.categories, "keyword", "left")
        sums = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in cats]
        full = found.groupBy(*ids, *record).agg(*sums).drop(*record)
        total = sum((F.col(f"`{c}`") for c in cats), F.lit(0).cast("long"))
        full = full.withColumn("总计", total)
        if self.spec.share:
            under = F.when(F.col("总计") == 0, 1).otherwise(F.col("总计"))
            full = full.withColumns({f"{c}_占比": F.round(F.col(f"`{c}`") / under, 6) for c in cats})
        return full

    @property
    def detail(self) -> DataFrame:
        """ids, keyword, count, category of every keyword found."""
        return self.by_category.select(*self._ids, F.col("keyword").alias("关键词"), F.col("n").alias("次数"), F.col("category").alias("分类"))

    @property
    def summary(self) -> DataFrame:
        """Totals of the categories and their part of all, largest first; categories never hit are there with 0."""
        found = self.by_category.groupBy("category").agg(F.sum("n").alias("n"))
        every = self.spark.createDataFrame([(i, c) for i, c in enumerate(self.dictionary.categories())], "pos int, category string")
        t = F.broadcast(every).join(found, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        grand = F.sum("n").over(Window.partitionBy())  # one row a category
        return t.select(F.col("category").alias("分类"), F.col("n").cast("long").alias("总次数"), percent(F.col("n"), grand).alias("占比(%)"), "pos").orderBy(F.desc("总次数"), "pos").drop("pos")

    @property
    def quality(self) -> DataFrame:
        """Counters of each file and of all, with rates."""
        counts = [F.count_if(c).alias(name) for c, name in zip(MASKS, COUNTERS[1:-1])]
        hits_of = F.aggregate("found", F.lit(0).cast("long"), lambda a, f: a + f["n"])
        per = self.facts.groupBy(F.col("来源文件").alias("f")).agg(F.count(F.lit(1)).alias("原始行数"), *counts, F.sum(hits_of).alias("关键词命中次数"))
        known = self.spark.createDataFrame(sorted(self.statuses.items()), "f string, s string")
        status = F.when(F.col("进入统计记录数") == 0, "无有效记录").otherwise(OK)
        per = per.join(F.broadcast(known), "f", "full").withColumn("状态", F.coalesce("s", status)).na.fill(0, list(COUNTERS))
        roll = per.rollup("f").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("状态").alias("状态"), F.count_if(F.col("状态") != OK).alias("bad"), F.grouping("f").alias("g"))
        return roll.select(
            F.when(F.col("g") == 1, "合计").otherwise(F.col("f")).alias("文件"),
            F.when(F.col("g") == 1, F.when(F.col("bad") > 0, "完成（含异常）").otherwise("完成")).otherwise(F.col("状态")).alias("状态"),
            *COUNTERS,
            percent(F.col("有效记录数"), F.col("原始行数")).alias("有效记录率(%)"),
            percent(F.greatest(F.col("有效记录数") - F.col("月份无法识别"), F.lit(0)), F.col("有效记录数")).alias("月份识别率(%)"),
        )

    @property
    def issues(self) -> DataFrame:
        """Rows with a defect, a row for each, the first of each chunk by reason then row."""
        reasons = F.array_compact(F.array(*[F.when(F.col(f"_m{i}"), F.struct(F.lit(i).alias("no"), F.lit(r).alias("reason"))) for i, r in enumerate(REASONS, 1)]))
        s = self.spec
        found = self.derived.select(
            F.col("_source_file").alias("来源文件"),
            F.col("_source_row").alias("源文件行号"),
            F.inline(reasons),
            date_text(F.col(f"`{s.code}`")).alias("原公司代码"),
            F.col("_date").alias("原日期值"),
        )
        chunk = F.floor((F.col("源文件行号") - 2) / CHUNK_ROWS)
        in_chunk = F.row_number().over(Window.partitionBy("来源文件", chunk).orderBy("no", "源文件行号"))
        in_file = F.row_number().over(Window.partitionBy("来源文件").orderBy(chunk, "no", "源文件行号"))
        kept = found.withColumn("a", in_chunk).filter(F.col("a") <= ISSUES_A_CHUNK).withColumn("b", in_file).filter(F.col("b") <= ISSUES_A_FILE)
        return kept.select("来源文件", "源文件行号", F.col("reason").alias("问题类型"), "原公司代码", "原日期值")

    @property
    def hits(self) -> DataFrame:
        """A row for each keyword and sentence it stands in."""
        found = self.sentence_hits.join(F.broadcast(self.dictionary.effective(self.spark)), "keyword", "left")
        return found.select("公司代码", "年份", "月份", "日期", "来源文件", "源文件行号", F.col("keyword").alias("命中关键词"), F.coalesce("category", F.lit("")).alias("分类"), F.col("sentence").alias("命中句子"))

    @property
    def duplicates(self) -> DataFrame:
        return duplicates_report(self.dictionary.to_df(self.spark))

    @property
    def run_summary(self) -> DataFrame:
        return self.main.agg(F.countDistinct("公司代码").alias("companies"), F.min("年份").alias("first_year"), F.max("年份").alias("last_year"), F.count(F.lit(1)).alias("rows"), F.sum("总计").alias("hits"))

    @property
    def metadata(self) -> DataFrame:
        """What the run was: its settings, its dictionary and the software, as key and value."""
        import platform

        import pyspark

        from termloom import __version__

        s = self.spec
        rows = [
            ("程序版本", __version__), ("Python", platform.python_version()), ("Spark", pyspark.__version__),
            ("统计方式", s.mode), ("匹配方式", "分词" if s.tokens else "包含"), ("公司代码列", s.code), ("日期列", s.date), ("文本列", "、".join(s.texts)),
            ("保留列", "、".join(s.retained)), ("占比", "是" if s.share else "否"), ("过滤疑似表格", "是" if s.drop_tables else "否"), ("句子最大长度", str(s.max_len)),
            ("停用词数", str(len(s.stopwords or ()))), ("词典指纹", self.dictionary.fingerprint()), ("分类数", str(len(self.dictionary.categories()))),
            ("关键词数", str(len(self.word_list))), ("保留名剔除", "、".join(self.reserved)), ("未处理文件数", str(len(self.statuses))),
        ]
        return self.spark.createDataFrame(rows, "`项目` string, `值` string")

    def sheets(self) -> dict[str, DataFrame]:
        """The sheets of the result workbook in order, sorted for the sink."""
        ids = self._ids
        names = {"raw": ("原始记录统计", "原始记录关键词"), "monthly": ("公司月份分类统计", "公司月份关键词"), "yearly": ("公司年份分类统计", "关键词明细")}[self.spec.mode]
        order = [F.asc_nulls_last(c) for c in ids]
        meta = self.metadata
        notes = [("计数口径", "每个关键词独立计数，忽略大小写，不重叠"), ("切句", "先切句再计数，疑似表格的句子不计")]
        files = self.manifest
        if files is None:
            files = self.facts.select(F.col("来源文件").alias("输入文件")).distinct()
        return {
            names[0]: self.main.orderBy(*order),
            names[1]: self.detail.orderBy(*order, "分类", "关键词"),
            "分类汇总": self.summary,
            "数据质量": self.quality.orderBy(F.col("文件") == "合计", "文件"),
            "异常记录": self.issues.orderBy("来源文件", "源文件行号").limit(ISSUES_A_RUN),
            "输入文件清单": files.orderBy("输入文件"),
            "运行元数据": meta,
            "词典诊断": self.duplicates.orderBy("keyword"),
            "分析说明": self.spark.createDataFrame(notes, "`项目` string, `说明` string"),
        }


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With 序号 from 1 in the given order, sorted by it.

    Rows are dealt by ranges of the order and numbered in each; the sizes of the
    ranges, a row each, are summed up and added. No task sees all rows.
    """
    from termloom.session import stage

    ranged = stage(df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["__range"], total))
        total += r.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__range int, __before long"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(f"`{c}`") for c in order]))
    found = ranged.withColumn("__inner", inner).join(offsets, "__range").withColumn("序号", F.col("__before") + F.col("__inner"))
    return found.select("序号", *df.columns).orderBy("序号")
