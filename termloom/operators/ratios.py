"""Joining sentence counts to risk tables and computing their ratios anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.fields import code_key, ratio, year_key

# Column names of the sentence panel and of the result; the reasons.
RENAMED = {"公司名称": "mda_company_name", "提取状态": "mda_extract_status", "句子数": "mda_sentence_count", "原始句子数": "mda_raw_sentence_count", "疑似表格段落数": "mda_table_like_paragraphs"}
COUNTS = ("mda_sentence_count", "mda_raw_sentence_count", "mda_table_like_paragraphs")
EXTRA = {"total_sentence_ratio": "total_freq", "physical_sentence_ratio": "physical_freq", "transition_sentence_ratio": "transition_freq"}
LABELS = {
    "stkcd_key": "股票代码（六位字符串键）",
    "year_key": "年份（字符串键）",
    "mda_company_name": "公司名称（MDA文本）",
    "mda_extract_status": "MDA提取状态",
    "mda_sentence_count": "MDA句子数（清洗表格后）",
    "mda_raw_sentence_count": "MDA原始句子数（清洗前）",
    "mda_table_like_paragraphs": "MDA疑似表格段落数",
    "mda_sentence_issue": "MDA句子分母异常原因",
    "total_sentence_ratio": "气候风险关键词命中总句数占MDA句子数比重",
    "physical_sentence_ratio": "物理风险关键词命中句数占MDA句子数比重",
    "transition_sentence_ratio": "转型风险关键词命中句数占MDA句子数比重",
}


def sentence_panel(df: DataFrame) -> DataFrame:
    """Keys and the five columns needed of a sentence panel, counts as numbers where they are."""
    named = df.withColumnsRenamed(RENAMED)
    counts = [F.col(c).cast("string").try_cast("double").alias(c) for c in COUNTS]
    return named.select(code_key(F.col("公司代码")).alias("stkcd_key"), year_key(F.col("年份")).alias("year_key"), "mda_company_name", "mda_extract_status", *counts)


def recalculate(risk: DataFrame, panel: DataFrame, code: str = "stkcd", year: str = "year") -> DataFrame:
    """``risk`` with sentence counts, why there is none, and every ratio over them; missing keys match missing keys."""
    names = risk.columns
    lacking = [c for c in names if c.endswith("_ratio") and c.replace("_ratio", "_freq") not in names] + [f for f in EXTRA.values() if f not in names]
    if lacking:
        raise ValueError(f"no frequencies for: {lacking}")
    keyed = risk.withColumns({"stkcd_key": code_key(F.col(code)), "year_key": year_key(F.col(year))})
    out = keyed.join(panel, ["stkcd_key", "year_key"], "left")
    n, status = F.col("mda_sentence_count"), F.col("mda_extract_status")
    issue = F.when(status.isNull(), "missing_mda_panel").when(status == "failed", "mda_extraction_failed").when(n.isNull(), "missing_sentence_count").when(n <= 0, "nonpositive_sentence_count").otherwise("")
    per = lambda c: ratio(F.col(c).cast("double"), n)
    ratios = {c: per(c.replace("_ratio", "_freq")) for c in names if c.endswith("_ratio")}
    out = out.withColumns({"mda_sentence_issue": issue, **ratios, **{new: per(freq) for new, freq in EXTRA.items()}})
    return out.select(*names, "stkcd_key", "year_key", *RENAMED.values(), "mda_sentence_issue", *EXTRA)


def labels(given: dict[str, str], columns: list[str]) -> dict[str, str]:
    """Variable labels of the result: the given ones, share labels reworded for ratios, and those of the new columns."""
    own = {c: (v.replace("占比", "占MDA句子数比重") if c.endswith("_ratio") else v) for c, v in given.items()} | LABELS
    return {c: own.get(c, c) for c in columns}


def issues(df: DataFrame) -> DataFrame:
    return df.filter("mda_sentence_issue <> ''")
