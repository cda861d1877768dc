"""Corpus panels: term frequencies of reports, hit tables, and the wide score panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.fields import ratio, zero_fill
from termloom.functions.text import occurrences, sentences, split_body
from termloom.operators.match import explode_sentences, hits, holding
from termloom.session import stage

# Statuses, tones, dimensions.
OK = "成功"
TONES = {0: "neg", 1: "neu", 2: "pos"}
DIMENSIONS = ("phys", "trans")


def report_sentences(reports: DataFrame, drop_tables: bool = True, marked: bool = True, max_len: int = 200) -> DataFrame:
    """code, year, sentences of reports (stem, text): names start code_year, the body follows its marker."""
    part = lambda i: F.get(F.split("stem", "_"), F.lit(i))
    good = reports.filter(part(0).rlike(r"^\p{Nd}{6}$") & part(1).rlike(r"^(?:19|20)\p{Nd}{2}$"))
    body = split_body(F.col("text"))["body"] if marked else F.col("text")
    return good.select("stem", part(0).alias("公司代码"), part(1).cast("int").alias("年份"), body.alias("body")).filter(F.col("body").isNotNull()).withColumn("sentences", sentences(F.col("body"), max_len, drop_tables)).drop("body")


def term_hits(cut: DataFrame, terms: DataFrame, probe: bool = False) -> DataFrame:
    """The sentences with each term in them, its tier and count; a term listed twice counts twice.

    ``probe`` rules sentences out by one alternation first; it pays where the
    match is not a join.
    """
    rows = explode_sentences(cut)
    listed = [r.term for r in terms.select("term").toLocalIterator()]  # the dictionary, bounded by its file
    if probe:
        rows = rows.filter(F.col("sentence").rlike("(?iu)" + "|".join(rf"\Q{t}\E" for t in sorted(set(listed), key=len, reverse=True))))
    return hits(rows, listed).withColumnRenamed("keyword", "term").join(F.broadcast(terms), "term")


def hit_table(found: DataFrame) -> DataFrame:
    """公司代码, 年份, 命中关键词, 分类, 命中句子, one row for each term and sentence of a company year."""
    keep = F.min(F.struct("pos", "tier_name"))["tier_name"]
    return found.groupBy("公司代码", "年份", F.col("term").alias("命中关键词"), F.col("sentence").alias("命中句子")).agg(keep.alias("分类")).select("公司代码", "年份", "命中关键词", "分类", "命中句子")


def distinct_hits(cut: DataFrame, terms: DataFrame) -> DataFrame:
    """The ``hit_table`` of the ``term_hits`` of ``cut``, with each text shuffled once and not once a term.

    The distinct sentences are found first and matched then. What is grouped by
    company, year and sentence afterwards needs no other shuffle.
    """
    listed = {r.term: r.tier_name for r in terms.orderBy(F.desc("pos")).collect()}  # the dictionary; the first of a term counts
    kinds = cut.sparkSession.createDataFrame(list(listed.items()), "term string, tier_name string")
    rows = explode_sentences(cut.select("公司代码", "年份", "sentences")).select("公司代码", "年份", "sentence")
    found = hits(holding(rows, list(listed)), list(listed)).join(F.broadcast(kinds), F.col("keyword") == F.col("term"))
    return found.select("公司代码", "年份", F.col("term").alias("命中关键词"), F.col("tier_name").alias("分类"), F.col("sentence").alias("命中句子"))


def keyword_panel(cut: DataFrame, found: DataFrame, terms: DataFrame, every_term: bool = False) -> DataFrame:
    """A row for each report: sentences, a column for each term hit anywhere (or all), totals and tiers, ratios null without sentences."""
    listed = terms.select("term", "tier").orderBy("pos").collect()  # the dictionary
    # written down, so that learning the terms hit does not cost a reading of the reports
    per = stage(found.groupBy("stem", "term").agg(F.sum("n").alias("n")))
    hit = {r.term for r in per.select("term").distinct().toLocalIterator()} if not every_term else {r.term for r in listed}
    columns = [t for t in dict.fromkeys(r.term for r in listed) if t in hit]
    wide = per.groupBy("stem").pivot("term", columns).agg(F.sum("n")) if columns else per.select("stem").distinct()
    tier = dict((r.term, r.tier) for r in listed)
    base = cut.select("stem", "公司代码", "年份", F.size("sentences").alias("mda_sent")).join(wide, "stem", "left")
    base = base.na.fill(0, columns).drop("stem")
    total = lambda names: sum((F.col(f"`{c}`") for c in names), F.lit(0).cast("long"))
    out = base.withColumn("total_freq", total(columns)).withColumn("total_ratio", ratio(F.col("total_freq"), F.col("mda_sent")))
    for t in sorted({r.tier for r in listed}):
        out = out.withColumn(f"t{t}_freq", total([c for c in columns if tier[c] == t])).withColumn(f"t{t}_ratio", ratio(F.col(f"t{t}_freq"), F.col("mda_sent")))
    return out


def scored_rows(scored: DataFrame, filled: bool = False) -> DataFrame:
    """Successful rows with both scores: code, year, keyword, sentence, phys, trans, tone (neutral if missing), occ.

    ``filled`` says that the codes have their zeros, as those of ``hit_table``
    do; they are then left as they are, and so is the partitioning by them.
    """
    num = lambda c: F.col(c).cast("string").try_cast("double").cast("int")
    rows = scored.filter(F.col("LLM分析状态") == OK).select(
        (F.col("公司代码") if filled else zero_fill(F.col("公司代码").cast("string"), 6)).alias("code"),
        F.col("年份").cast("int").alias("year"),
        F.col("命中关键词").alias("keyword"),
        F.col("命中句子").alias("sentence"),
        num("LLM物理分数").alias("phys"),
        num("LLM转型分数").alias("trans"),
        F.coalesce(num("LLM语气语调"), F.lit(1)).alias("tone"),
    )
    return rows.filter("phys is not null and trans is not null and code is not null and year is not null").withColumn("occ", F.greatest(F.lit(1).cast("long"), occurrences(F.col("sentence"), F.col("keyword"))))


def _by_sentence(rows: DataFrame, keys: list[str], metrics: dict[str, tuple[str, Column]]) -> DataFrame:
    """The metrics of each group: a ``sum`` over its rows, or a ``count`` of the distinct sentences with a condition.

    Rows are first brought to one a sentence, with a bit for each condition met, so that
    a text is shuffled once at most; distinct counts are given a copy for every condition.
    """
    sums = {name: c for name, (kind, c) in metrics.items() if kind == "sum"}
    bits = {name: 1 << i for i, name in enumerate(m for m in metrics if m not in sums)}
    met = sum((F.when(metrics[name][1], bit).otherwise(0) for name, bit in bits.items()), F.lit(0))
    one = rows.groupBy(*keys, "sentence").agg(*[F.sum(c).alias(name) for name, c in sums.items()], F.bit_or(F.when(F.col("sentence").isNotNull(), met).otherwise(0)).alias("__met"))
    total = lambda name: F.sum(name) if name in sums else F.count_if(F.col("__met").bitwiseAND(bits[name]) != 0)
    return one.groupBy(*keys).agg(*[total(name).alias(name) for name in metrics])


def firm_year(rows: DataFrame) -> DataFrame:
    """Distinct sentences and score sums of each company year."""
    metrics = {"hit_sent": ("count", F.lit(True)), "phys_sum": ("sum", F.col("phys")), "trans_sum": ("sum", F.col("trans"))}
    for d in DIMENSIONS:
        metrics |= {f"{d}_rel_sent": ("count", F.col(d) >= 1), f"{d}_zero_sent": ("count", F.col(d) == 0)}
    return _by_sentence(rows, ["code", "year"], metrics)


def keyword_metrics(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The 22 metrics of each company, year and listed term, long; terms not listed are left out."""
    joined = rows.join(F.broadcast(terms.groupBy(F.col("term").alias("keyword")).agg(F.max("var").alias("var"))), "keyword")
    add = lambda cond, c: ("sum", F.when(cond, F.col(c)).otherwise(0))
    metrics = {"occ_all": ("sum", F.col("occ")), "sent_all": ("count", F.lit(True))}
    for d in DIMENSIONS:
        hit = F.col(d) >= 1
        metrics |= {f"{d}_occ": add(hit, "occ"), f"{d}_sent": ("count", hit), f"{d}_score": ("sum", F.col(d)), f"{d}_zero_sent": ("count", F.col(d) == 0)}
        for code, name in TONES.items():
            toned = hit & (F.col("tone") == code)
            metrics |= {f"{d}_{name}_occ": add(toned, "occ"), f"{d}_{name}_sent": ("count", toned)}
    return _by_sentence(joined, ["code", "year", "var"], metrics)


def wide_metrics(metrics: DataFrame, variables: list[str]) -> DataFrame:
    """One row a company year with kwNNN_metric columns for every listed term, 0 where it was never met."""
    names = [c for c in metrics.columns if c not in ("code", "year", "var")]
    wide = metrics.groupBy("code", "year").pivot("var", variables).agg(*[F.first(c).alias(c) for c in names])
    return wide.na.fill(0).select("code", "year", *[F.col(f"{v}_{n}").cast("int").alias(f"{v}_{n}") for n in names for v in variables])


def score_panel(panel: DataFrame, scored: DataFrame, terms: DataFrame, filled: bool = False) -> DataFrame:
    """The keyword panel with company-year and keyword metrics joined on, 0 where there are none."""
    rows = scored_rows(scored, filled)
    variables = [r["var"] for r in terms.orderBy("pos").collect()]
    base = panel.select(zero_fill(F.col("公司代码").cast("string"), 6).alias("code"), F.col("年份").cast("int").alias("year"), "mda_sent", "total_freq", "total_ratio")
    out = base.join(firm_year(rows), ["code", "year"], "left").join(wide_metrics(keyword_metrics(rows, terms), variables), ["code", "year"], "left")
    filled = [c for c in out.columns if c not in ("code", "year", "total_ratio")]
    return out.na.fill(0, filled).withColumns({c: F.col(c).cast("int") for c in filled if c != "mda_sent"})
