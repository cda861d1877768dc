"""Registered queries of the analysis operators, each with its SQL twin where SQL can say it.

The documents table has no Han text, codes or dates; ``reports`` derives them by
a fixed rule that Spark and SQL share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import fields as D
from termloom.functions import text as T
from termloom.operators import match, panel, ratios, scoring, section
from termloom.operators.dictionary import Dictionary, tiered
from termloom.plans.analysis import Analysis, Spec, numbered
from termloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ALPHABET = "abcdefghijklmnopqrstuvwxyz."
HAN = "".join(chr(0x4E00 + 37 * i) for i in range(26)) + "。"


def han(word: str) -> str:
    return word.translate(str.maketrans(ALPHABET, HAN))


#: ``er`` is in two categories on purpose: the last one counts.
LATIN = {"function": ["the", "er", "tion"], "german": ["und", "ESG"], "romance": ["que", "de", "ation", "a.b", "er"]}
DICTIONARY = Dictionary({c: [han(w) if w.islower() and w.isalpha() else w for w in words] for c, words in LATIN.items()})
TERMS = [("the", 1, "function"), ("tion", 1, "function"), ("und", 2, "german"), ("que", 3, "romance"), ("er", 3, "romance"), ("zzzz", 3, "romance")]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, raw_code, raw_date, han_text of every document."""
    n = (F.col("doc_id") % 50 + 1).cast("string")
    d = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 37 % 1500).cast("int"))
    y, m, day = (f(d).cast("string") for f in (F.year, F.month, F.dayofmonth))
    k, c = F.col("doc_id") % 6, F.col("doc_id") % 7
    cells = F.struct(
        "doc_id",
        "source",
        F.when(c == 0, "").when(c == 1, F.concat(n, F.lit(".SZ"))).when(c == 2, F.concat(n, F.lit(".0"))).otherwise(n).alias("raw_code"),
        F.when(k == 0, d.cast("string")).when(k == 1, F.concat_ws("/", y, m, day)).when(k == 2, F.concat(y, F.lit("年"), m, F.lit("月"), day, F.lit("日")))
        .when(k == 3, F.concat(y, F.lit("年"))).when(k == 4, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).otherwise("无法识别").alias("raw_date"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.translate(F.lower("text"), ALPHABET, HAN)).alias("han_text"),
    )
    # a generator, so that what reads a cell several times does not make it several times
    return table(spark, sf_dir, "documents").select(F.inline(F.array(cells)))


def _resplit_sql(parts: str, most: int = 200) -> str:
    """The SQL of ``resplit`` over a list of segments: greedy packing at each delimiter in turn, then a cut at every ``most`` characters."""
    for d in ("；", ";", "，", ","):
        pieces = f"list_transform(string_split(s, '{d}'), lambda p: {{'open': p, 'done': cast([] as varchar[])}})"
        step = (
            f"case when a.open = '' then {{'open': x.open, 'done': a.done}} when length(a.open) + 1 + length(x.open) > {most} then {{'open': x.open, 'done': list_append(a.done, a.open)}} "
            f"else {{'open': a.open || '{d}' || x.open, 'done': a.done}} end"
        )
        packed = f"list_transform([list_reduce({pieces}, lambda a, x: {step})], lambda r: case when r.open <> '' then list_append(r.done, r.open) else r.done end)[1]"
        parts = f"flatten(list_transform({parts}, lambda s: case when length(s) > {most} and contains(s, '{d}') then {packed} else [s] end))"
    return f"flatten(list_transform({parts}, lambda s: case when length(s) > {most} then list_transform(range(0, (length(s) - 1) // {most} + 1), lambda i: substr(s, i * {most} + 1, {most})) else [s] end))"


def _sentences_sql(text: str) -> str:
    """The SQL of ``sentences`` for texts without page furniture, line breaks or paragraph breaks."""
    blank = r"[\s\x{85}\x{A0}\x{3000}]"
    strip = f"lambda s: regexp_replace(s, '^{blank}+|{blank}+$', '', 'g')"
    parts = f"list_filter(list_transform(string_split_regex(replace({text}, chr(10), ''), '[。！？!?]'), {strip}), lambda s: s <> '')"
    return f"""list_filter(list_transform({_resplit_sql(parts)}, {strip}),
    lambda s: length(s) >= 8 and length(regexp_replace(s, '[^一-龥]', '', 'g')) >= 8 and length(regexp_replace(s, '[^0-9,.%\\-—、|/ ]', '', 'g')) / length(s) <= 0.45)"""


# The SQL of the same: records with code, year and month as the rules give them for these cells.
SQL_REPORTS = f"""
dated as (select *, date '2020-01-01' + cast(doc_id * 37 % 1500 as integer) as d, cast(doc_id % 50 + 1 as varchar) as n from documents),
reports as (select doc_id, source,
  case doc_id % 7 when 0 then '' when 1 then n || '.SZ' when 2 then n || '.0' else n end as raw_code,
  case doc_id % 6 when 0 then cast(cast(d as date) as varchar) when 1 then year(d) || '/' || month(d) || '/' || day(d)
    when 2 then year(d) || '年' || month(d) || '月' || day(d) || '日' when 3 then year(d) || '年'
    when 4 then cast(date_diff('day', date '1899-12-30', cast(d as date)) as varchar) else '无法识别' end as raw_date,
  case when doc_id % 11 = 0 then '' else translate(lower(text), '{ALPHABET}', '{HAN}') end as han_text, d
  from dated),
records as (select doc_id, source, raw_code, raw_date, han_text,
  case when doc_id % 7 = 0 then '' else lpad(cast(doc_id % 50 + 1 as varchar), 6, '0') end as code,
  cast(case when doc_id % 6 = 5 then 0 else year(d) end as integer) as yr,
  cast(case when doc_id % 6 in (3, 5) then 0 else month(d) end as integer) as mon,
  case when doc_id % 6 = 4 then cast(cast(d as date) as varchar) else raw_date end as shown
  from reports),
valid as (select * from records where code <> '' and yr > 0),
cut as (select doc_id, source, code, yr, mon, shown, {_sentences_sql("han_text")} as sents from valid),
sents as (select doc_id, source, code, yr, mon, shown, cast(unnest(range(len(sents))) as integer) as sent_no, unnest(sents) as sentence from cut)"""

WORDS_SQL = ", ".join(f"('{w}', '{c}')" for w, c in sorted(DICTIONARY.category_of().items()))
SQL_HITS = f"""{SQL_REPORTS},
words(keyword, category) as (values {WORDS_SQL}),
found as (select s.*, w.keyword, w.category, cast((length(lower(sentence)) - length(replace(lower(sentence), lower(keyword), ''))) / length(keyword) as bigint) as n
  from sents s join words w on contains(lower(s.sentence), lower(w.keyword)))"""
CATEGORIES = DICTIONARY.categories()

def spec(mode: str = "raw", **more) -> Spec:
    return Spec("raw_code", "raw_date", ("han_text",), mode, source_file="source", source_row="row", **more)


def analysis(spark: SparkSession, sf_dir: str, mode: str = "raw", **more) -> Analysis:
    return Analysis(reports(spark, sf_dir).withColumn("row", F.col("doc_id") + 2), DICTIONARY, spec(mode, **more))


# --- codes and dates -------------------------------------------------------


@query("D01_D04_codes_and_dates", f"with {SQL_REPORTS} select doc_id, code, yr, mon, shown from records")
def codes_and_dates(spark, sf_dir):
    c, d = F.col("raw_code"), F.col("raw_date")
    return reports(spark, sf_dir).select("doc_id", D.stock_code(c).alias("code"), D.year_of(d).alias("yr"), D.month_of(d).alias("mon"), D.date_text(d).alias("shown"))


@query(
    "D05_D07_keys_and_ratios",
    """select o_orderkey, lpad(cast(o_custkey as varchar), cast(greatest(6, length(cast(o_custkey as varchar))) as integer), '0') as code_key, cast(year(o_orderdate) as varchar) as year_key,
    case when o_custkey % 7 > 0 then o_totalprice / (o_custkey % 7) end as ratio from orders""",
)
def keys_and_ratios(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", D.code_key(F.col("o_custkey")).alias("code_key"), D.year_key(F.year("o_orderdate")).alias("year_key"), D.ratio(F.col("o_totalprice"), F.col("o_custkey") % 7).alias("ratio")
    )


@query("D09_versions", "select v, list_transform(regexp_extract_all(v, '[0-9]+'), lambda x: cast(x as integer)) > [4, 1] as newer from (values ('v4.2.0'), ('4.1'), ('4.0.9'), ('v10')) t(v)")
def versions(spark, sf_dir):
    df = spark.createDataFrame([("v4.2.0",), ("4.1",), ("4.0.9",), ("v10",)], "v string")
    return df.select("v", (D.version_key(F.col("v")) > F.array(F.lit(4), F.lit(1))).alias("newer"))


# --- masks, quality, issues --------------------------------------------------


@query(
    "P04_masks",
    f"""with {SQL_REPORTS} select doc_id, code = '' as no_code, code <> '' and yr = 0 as no_year, code <> '' and yr > 0 as valid,
    code <> '' and yr > 0 and mon = 0 as no_month, code <> '' and yr > 0 and han_text = '' as no_text from records""",
)
def masks(spark, sf_dir):
    d = analysis(spark, sf_dir).derived
    return d.select("doc_id", F.col("_m1").alias("no_code"), F.col("_m2").alias("no_year"), F.col("_valid").alias("valid"), F.col("_m3").alias("no_month"), F.col("_m4").alias("no_text"))


COUNTS_SQL = """count(*) as raw_rows, count_if(code <> '' and yr > 0) as valid_rows, count_if(code <> '' and yr > 0 and mon > 0) as used_rows, count_if(code = '') as no_code,
  count_if(code <> '' and yr = 0) as no_year, count_if(code <> '' and yr > 0 and mon = 0) as no_month, count_if(code <> '' and yr > 0 and han_text = '') as no_text"""


@query(
    "A08_A09_quality",
    f"""with {SQL_HITS}, per as (select source as f, {COUNTS_SQL} from records group by source),
    h as (select source as f, cast(sum(n) as bigint) as hits from found where mon > 0 group by source),
    files as (select per.*, coalesce(hits, 0) as hits, case when used_rows = 0 then '无有效记录' else '成功' end as status from per left join h using (f)),
    every as (select '合计' as f, sum(raw_rows) raw_rows, sum(valid_rows) valid_rows, sum(used_rows) used_rows, sum(no_code) no_code, sum(no_year) no_year, sum(no_month) no_month, sum(no_text) no_text,
      sum(hits) hits, case when count_if(status <> '成功') > 0 then '完成（含异常）' else '完成' end as status from files),
    u as (select f, raw_rows, valid_rows, used_rows, no_code, no_year, no_month, no_text, hits, status from files union all by name select * from every)
    select f as file, status, cast(raw_rows as bigint) raw_rows, cast(valid_rows as bigint) valid_rows, cast(used_rows as bigint) used_rows, cast(no_code as bigint) no_code, cast(no_year as bigint) no_year,
      cast(no_month as bigint) no_month, cast(no_text as bigint) no_text, cast(hits as bigint) hits,
      case when raw_rows <> 0 then round(valid_rows / raw_rows * 100, 2) else 0.0 end as valid_rate, case when valid_rows <> 0 then round(greatest(valid_rows - no_month, 0) / valid_rows * 100, 2) else 0.0 end as month_rate from u""",
)
def quality(spark, sf_dir):
    names = ["file", "status", "raw_rows", "valid_rows", "used_rows", "no_code", "no_year", "no_month", "no_text", "hits", "valid_rate", "month_rate"]
    return analysis(spark, sf_dir, "monthly").quality.toDF(*names)


@query(
    "Q02_W04_issues",
    f"""with {SQL_REPORTS}, flags as (select source, doc_id + 2 as row_no, code, yr, mon, han_text, raw_code, shown,
      [case when code = '' then 1 end, case when code <> '' and yr = 0 then 2 end, case when code <> '' and yr > 0 and mon = 0 then 3 end, case when code <> '' and yr > 0 and han_text = '' then 4 end] as k from records),
    e as (select source, row_no, raw_code, shown, unnest(list_filter(k, lambda x: x is not null)) as no from flags),
    r as (select *, row_number() over (partition by source, (row_no - 2) // 10000 order by no, row_no) as a from e),
    s as (select *, row_number() over (partition by source order by (row_no - 2) // 10000, no, row_no) as b from r where a <= 250)
    select source, row_no, ['公司代码为空', '年份无法识别', '月份无法识别', '文本为空'][no] as reason, raw_code, shown from s where b <= 10000""",
)
def issues(spark, sf_dir):
    return analysis(spark, sf_dir).issues.toDF("source", "row_no", "reason", "raw_code", "shown")


# --- sentences ---------------------------------------------------------------


@query("F04_F06_W05_sentences", f"with {SQL_REPORTS} select doc_id, sent_no, sentence from sents")
def sentence_rows(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.sentence_rows.select((F.col("源文件行号") - 2).alias("doc_id"), "sent_no", "sentence")


@query("F06_resplit_sentences")
def resplit_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text"), drop_tables=False).alias("sentences"))
    return match.explode_sentences(d)


@query(
    "F05_table_like",
    f"""with {SQL_REPORTS} select doc_id, length(han_text) = 0 or length(regexp_replace(han_text, '[^一-龥]', '', 'g')) < 8
    or length(regexp_replace(han_text, '[^0-9,.%\\-—、|/ ]', '', 'g')) / length(han_text) > 0.45 as table_like from reports""",
)
def table_like(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", F.coalesce(T.is_table_like(F.col("han_text")), F.lit(True)).alias("table_like"))


@query("F10_F12_blanks", "select doc_id, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) as line, cast(length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) as integer) as chars from documents")
def blanks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("line"), T.body_chars(F.col("text")).alias("chars"))


@query("F11_paragraphs")
def paragraph_filter(spark, sf_dir):
    body = F.replace(F.replace(F.col("han_text"), F.lit("。"), F.lit("。\n")), F.lit("\n\n"), F.lit("\n \n"))
    return reports(spark, sf_dir).select("doc_id", T.paragraphs(body).alias("p")).select("doc_id", "p.text", "p.dropped")


@query(
    "F05_F08_names",
    """with f as (select doc_id, lpad(cast(doc_id % 1000 as varchar), 6, '0') || '_20' || lpad(cast(doc_id % 30 as varchar), 2, '0') || '_' || source || '_title_2021-01-01' as stem from documents)
    select doc_id, string_split(stem, '_')[1] as code, string_split(stem, '_')[2] as yr, string_split(stem, '_')[3] as company, string_split(stem, '_')[4] as title, string_split(stem, '_')[5] as day from f""",
)
def names(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stem = F.concat_ws("_", F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"), F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")), "source", F.lit("title"), F.lit("2021-01-01"))
    m = D.report_meta(stem)
    return d.select("doc_id", m["code"].alias("code"), m["year"].alias("yr"), m["company"].alias("company"), m["title"].alias("title"), m["date"].alias("day"))


# --- keyword counts ----------------------------------------------------------


@query(
    "F13_F14_counts",
    """select doc_id, keyword, cast((length(lower(text)) - length(replace(lower(text), keyword, ''))) / length(keyword) as bigint) as n
    from documents, (values ('the'), ('tion'), ('er'), ('und'), ('que')) w(keyword)""",
)
def counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pairs = F.inline(F.array(*[F.struct(F.lit(w).alias("keyword"), T.occurrences(F.col("text"), F.lit(w)).alias("n")) for w in ("the", "tion", "er", "und", "que")]))
    return d.select("doc_id", pairs)


@query("J01_sentence_hits", f"with {SQL_HITS} select doc_id, sent_no, keyword, n from found")
def sentence_hits(spark, sf_dir):
    return analysis(spark, sf_dir).sentence_hits.select((F.col("源文件行号") - 2).alias("doc_id"), "sent_no", "keyword", "n")


@query("J01_automaton_hits", f"with {SQL_HITS} select doc_id, sent_no, keyword, n from found")
def automaton_hits(spark, sf_dir):
    rows = analysis(spark, sf_dir).sentence_rows.select((F.col("源文件行号") - 2).alias("doc_id"), "sent_no", "sentence")
    return match.hits(rows, DICTIONARY.keywords(), most=0).drop("sentence")


TOKEN_SQL = "with t as (select doc_id, unnest(list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '')) as keyword from documents) select doc_id, keyword, count(*) as n from t where keyword in {} group by all"


@query("F15_J02_J03_tokens", TOKEN_SQL.format("('the', 'of', 'und', 'que', 'The')"))
def token_counts(spark, sf_dir):
    d = match.tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return match.token_hits(d, ["the", "of", "und", "que", "de", "The"], ["doc_id"], frozenset({"de"}))


@query("F15_longest_match_tokens")
def longest_match_tokens(spark, sf_dir):
    d = reports(spark, sf_dir).select("doc_id", "han_text")
    cut = match.tokens(d, "han_text", match.longest_match(DICTIONARY.keywords()), DICTIONARY.keywords())
    return match.token_hits(cut, DICTIONARY.keywords(), ["doc_id"])


# --- panels --------------------------------------------------------------------


def _wide_sql(ids: str, rows: str, where: str) -> str:
    per = ", ".join(f"cast(coalesce(sum(n) filter (category = '{c}'), 0) as bigint) as \"{c}\"" for c in CATEGORIES)
    return f"""with {SQL_HITS}, w as (select {ids}, {per}, cast(coalesce(sum(n), 0) as bigint) as total from {rows} left join (select doc_id, category, n from found) using (doc_id) where {where} group by {ids})
    select * from w"""


@query("A02_A04_monthly", _wide_sql("code, yr, mon", "valid", "mon > 0"))
def monthly(spark, sf_dir):
    return analysis(spark, sf_dir, "monthly").main.toDF("code", "yr", "mon", *CATEGORIES, "total")


@query("A01_A04_yearly", _wide_sql("code, yr", "valid", "true"))
def yearly(spark, sf_dir):
    return analysis(spark, sf_dir, "yearly").main.toDF("code", "yr", *CATEGORIES, "total")


SHARES = ", ".join(f"round(\"{c}\" / (case when total = 0 then 1 else total end), 6) as \"{c}_share\"" for c in CATEGORIES)


@query("A05_shares", _wide_sql("code, yr", "valid", "true").replace("select * from w", f"select *, {SHARES} from w"))
def shares(spark, sf_dir):
    return analysis(spark, sf_dir, "yearly", share=True).main.toDF("code", "yr", *CATEGORIES, "total", *[f"{c}_share" for c in CATEGORIES])


@query("A03_P06_raw", _wide_sql("doc_id, source, code, yr, mon, shown", "valid", "true").replace("select * from w", "select * replace (case when mon > 0 then mon end as mon) from w"))
def raw(spark, sf_dir):
    m = analysis(spark, sf_dir, retained=("doc_id",)).main
    return m.drop("源文件行号").toDF("code", "yr", "mon", "shown", "source", "doc_id", *CATEGORIES, "total")


@query("A07_keyword_detail", f"with {SQL_HITS} select code, yr, keyword, cast(sum(n) as bigint) as n, category from found group by all")
def keyword_detail(spark, sf_dir):
    return analysis(spark, sf_dir, "yearly").detail.toDF("code", "yr", "keyword", "n", "category")


@query(
    "A06_W06_summary",
    f"""with {SQL_HITS}, c(category) as (values {", ".join(f"('{c}')" for c in CATEGORIES)}), t as (select c.category, coalesce(sum(n), 0) as n from c left join found on c.category = found.category group by c.category)
    select category, cast(n as bigint) as n, case when sum(n) over () <> 0 then round(n / sum(n) over () * 100, 2) else 0.0 end as pct from t""",
)
def summary(spark, sf_dir):
    return analysis(spark, sf_dir).summary.toDF("category", "n", "pct")


@query("J04_F16_hits_table", f"with {SQL_HITS} select code, yr, case when mon > 0 then mon end as mon, shown, source, doc_id + 2 as row_no, keyword, category, sentence from found")
def hits_table(spark, sf_dir):
    return analysis(spark, sf_dir).hits.toDF("code", "yr", "mon", "shown", "source", "row_no", "keyword", "category", "sentence")


@query("A21_run_summary", f"with {SQL_HITS} select (select count(distinct code) from valid) as companies, (select min(yr) from valid) as first_year, (select max(yr) from valid) as last_year, (select count(*) from valid) as n_rows, (select cast(sum(n) as bigint) from found) as hits")
def run_summary(spark, sf_dir):
    return analysis(spark, sf_dir).run_summary.toDF("companies", "first_year", "last_year", "n_rows", "hits")


# --- dictionary ------------------------------------------------------------------

DICT_SQL = "d(cat_pos, category, kw_pos, keyword) as (values " + ", ".join(f"({i}, '{c}', {j}, '{w}')" for i, c in enumerate(CATEGORIES) for j, w in enumerate(DICTIONARY.words(c))) + ")"


@query("A10_duplicates", f"with {DICT_SQL} select keyword, string_agg(category, '、' order by cat_pos) as categories, last(category order by cat_pos) as effective from d group by keyword having count(*) > 1")
def duplicates(spark, sf_dir):
    return Analysis(reports(spark, sf_dir), DICTIONARY, spec()).duplicates


@query("A11_dictionary_counts", f"with {DICT_SQL} select category, count(*) as n, (select count(distinct keyword) from d) as distinct_words, (select count(*) from d) as total from d group by category")
def dictionary_counts(spark, sf_dir):
    d = DICTIONARY.to_df(spark)
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(d.agg(F.count_distinct("keyword").alias("distinct_words"), F.count(F.lit(1)).alias("total"))))


@query("P07_U03_reserved", f"with {DICT_SQL} select keyword from d where category <> 'german' and keyword not in ('a.b', '{han('de')}')")
def reserved(spark, sf_dir):
    clean, _ = DICTIONARY.without_reserved({"german", "a.b", han("de")})
    return clean.to_df(spark).select("keyword")


@query("P18_search", "select w as keyword from (values ('the'), ('tion'), ('ation')) t(w) where contains(lower(w), 'ti')")
def search(spark, sf_dir):
    d = Dictionary({"x": ["the", "tion", "ation"]})
    return spark.createDataFrame([(w,) for w in d.search("x", "TI")], "keyword string")


@query("U05_merge", "select * from (values (0, 'a', 0, 'x'), (0, 'a', 1, 'y'), (0, 'a', 2, 'z'), (1, 'b', 0, 'x')) t(cat_pos, category, kw_pos, keyword)")
def merge(spark, sf_dir):
    d = Dictionary({"a": ["x", "y"], "b": ["x"]})
    d.merge(Dictionary({"a": ["y", "z"]}))
    return d.to_df(spark)


@query("H02_fingerprint", "select sha256(string_agg(t || chr(0), '' order by i)) as fp from (values (0, 'a'), (1, 'x'), (2, 'y'), (3, 'b'), (4, 'z')) v(i, t)")
def fingerprint(spark, sf_dir):
    return spark.createDataFrame([(Dictionary({"b": ["z"], "a": ["y", "x"]}).fingerprint(),)], "fp string")


# --- corpus panels -----------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stem = F.concat(F.lpad((F.col("doc_id") % 50 + 1).cast("string"), 6, "0"), F.lit("_"), (F.col("doc_id") % 5 + 2018).cast("string"), F.lit("_"), F.col("doc_id").cast("string"))
    d = reports(spark, sf_dir).select(stem.alias("stem"), F.concat(F.lit(f"head\n{T.BODY_MARKER}\n"), "han_text").alias("text"))
    cut = panel.report_sentences(d)
    terms = tiered(spark, [(han(t), n, name) for t, n, name in TERMS])
    return cut, panel.term_hits(cut, terms), terms


SQL_CORPUS = f"""{SQL_REPORTS.split("records as")[0].rstrip().rstrip(",")},
terms(pos, term, tier, tier_name) as (values {", ".join(f"({i}, '{han(t)}', {n}, '{name}')" for i, (t, n, name) in enumerate(TERMS))}),
ccut as (select lpad(cast(doc_id % 50 + 1 as varchar), 6, '0') as code, cast(doc_id % 5 + 2018 as integer) as yr, doc_id, {_sentences_sql("han_text")} as sents from reports),
cs as (select code, yr, doc_id, unnest(sents) as sentence from ccut),
cf as (select cs.*, terms.*, cast((length(lower(sentence)) - length(replace(lower(sentence), term, ''))) / length(term) as bigint) as n from cs join terms on contains(lower(sentence), term))"""


@query("A12_term_counts", f"with {SQL_CORPUS} select doc_id, term, cast(sum(n) as bigint) as n from cf group by all")
def term_counts(spark, sf_dir):
    _, found, _ = corpus(spark, sf_dir)
    return found.groupBy(F.element_at(F.split("stem", "_"), 3).cast("long").alias("doc_id"), "term").agg(F.sum("n").alias("n"))


@query("A14_hit_table", f"with {SQL_CORPUS} select distinct code, yr, term, tier_name, sentence from cf")
def corpus_hit_table(spark, sf_dir):
    _, found, _ = corpus(spark, sf_dir)
    return panel.hit_table(found).toDF("code", "yr", "term", "tier_name", "sentence")


def scored(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Hits with scores made from the sentence's length, so that no model is needed; ``held`` is the cut corpus, if it is written down."""
    cut, _, terms = corpus(spark, sf_dir)
    n = F.length("命中句子")
    t = panel.distinct_hits(cut if held is None else held, terms)
    return t.withColumns({"LLM物理分数": n % 5, "LLM转型分数": n % 4, "LLM语气语调": n % 3, "LLM分析状态": F.when(n % 13 == 0, "失败").otherwise("成功")})


SQL_SCORED = f"""{SQL_CORPUS}, hit as (select distinct code, yr, term, sentence from cf),
sc as (select *, length(sentence) % 5 as phys, length(sentence) % 4 as trans, length(sentence) % 3 as tone,
  greatest(1, cast((length(lower(sentence)) - length(replace(lower(sentence), term, ''))) / length(term) as bigint)) as occ from hit where length(sentence) % 13 <> 0)"""
FIRM_SQL = """count(distinct sentence) as hit_sent, cast(sum(phys) as bigint) as phys_sum, cast(sum(trans) as bigint) as trans_sum,
  count(distinct sentence) filter (phys >= 1) as phys_rel_sent, count(distinct sentence) filter (phys = 0) as phys_zero_sent,
  count(distinct sentence) filter (trans >= 1) as trans_rel_sent, count(distinct sentence) filter (trans = 0) as trans_zero_sent"""


@query("A15_firm_year", f"with {SQL_SCORED} select code, yr, {FIRM_SQL} from sc group by code, yr")
def firm_year(spark, sf_dir):
    return panel.firm_year(panel.scored_rows(scored(spark, sf_dir), filled=True)).withColumnRenamed("year", "yr")


METRIC_SQL = "cast(sum(occ) as bigint) as occ_all, count(distinct sentence) as sent_all, " + ", ".join(
    f"cast(coalesce(sum(occ) filter ({d} >= 1), 0) as bigint) as {d}_occ, count(distinct sentence) filter ({d} >= 1) as {d}_sent, cast(sum({d}) as bigint) as {d}_score, count(distinct sentence) filter ({d} = 0) as {d}_zero_sent, "
    + ", ".join(f"cast(coalesce(sum(occ) filter ({d} >= 1 and tone = {k}), 0) as bigint) as {d}_{n}_occ, count(distinct sentence) filter ({d} >= 1 and tone = {k}) as {d}_{n}_sent" for k, n in panel.TONES.items())
    for d in panel.DIMENSIONS
)


@query("A16_J08_keyword_metrics", f"with {SQL_SCORED} select code, yr, 'kw' || lpad(cast(pos + 1 as varchar), 3, '0') as var, {METRIC_SQL} from sc join terms using (term) group by code, yr, pos")
def keyword_metrics(spark, sf_dir):
    _, _, terms = corpus(spark, sf_dir)
    return panel.keyword_metrics(panel.scored_rows(scored(spark, sf_dir), filled=True), terms).withColumnRenamed("year", "yr")


RISK_SQL = """risk as (select o_orderkey, case when o_orderkey % 17 = 0 then null else cast(o_custkey as varchar) end as stkcd, cast(1992 + o_orderkey % 7 as varchar) as year,
    o_totalprice as total_freq, o_totalprice / 2 as physical_freq, o_totalprice / 4 as transition_freq from orders),
  panel as (select case when c_custkey % 13 = 0 then null else lpad(cast(c_custkey as varchar), cast(greatest(6, length(cast(c_custkey as varchar))) as integer), '0') end as code,
    cast(1992 + c_custkey % 7 as varchar) as yr, c_name, case when c_custkey % 5 = 0 then 'failed' else 'success' end as status,
    case when c_custkey % 4 = 0 then null else c_custkey % 3 * 10 end as n from customer)"""


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    risk = o.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey").cast("string")).alias("stkcd"), (F.col("o_orderkey") % 7 + 1992).cast("string").alias("year"),
        F.col("o_totalprice").alias("total_freq"), (F.col("o_totalprice") / 2).alias("physical_freq"), (F.col("o_totalprice") / 4).alias("transition_freq"), F.lit(0.0).alias("total_ratio"),
    )
    p = c.select(
        F.when(k % 13 != 0, k.cast("string")).alias("公司代码"), (k % 7 + 1992).cast("string").alias("年份"), F.col("c_name").alias("公司名称"), F.when(k % 5 == 0, "failed").otherwise("success").alias("提取状态"),
        F.when(k % 4 != 0, k % 3 * 10).cast("string").alias("句子数"), F.lit("1").alias("原始句子数"), F.lit("x").alias("疑似表格段落数"),
    )
    return ratios.recalculate(risk, ratios.sentence_panel(p))


@query(
    "J07_A19_A20_ratios",
    f"""with {RISK_SQL}, k as (select *, coalesce(lpad(stkcd, cast(greatest(6, length(stkcd)) as integer), '0'), '00<NA>') as ck from risk), p as (select *, coalesce(code, '00<NA>') as ck from panel)
    select o_orderkey, k.ck as stkcd_key, k.year as year_key, c_name, status, cast(n as double) as n,
      case when status is null then 'missing_mda_panel' when status = 'failed' then 'mda_extraction_failed' when n is null then 'missing_sentence_count' when n <= 0 then 'nonpositive_sentence_count' else '' end as issue,
      case when n > 0 then total_freq / n end as total_ratio, case when n > 0 then total_freq / n end as total_sentence_ratio, case when n > 0 then physical_freq / n end as physical_sentence_ratio, case when n > 0 then transition_freq / n end as transition_sentence_ratio
    from k left join p on k.ck = p.ck and k.year = p.yr""",
)
def ratio_table(spark, sf_dir):
    r = _risk(spark, sf_dir).withColumnsRenamed({"mda_company_name": "c_name", "mda_extract_status": "status", "mda_sentence_count": "n", "mda_sentence_issue": "issue"})
    return r.select("o_orderkey", "stkcd_key", "year_key", "c_name", "status", "n", "issue", "total_ratio", "total_sentence_ratio", "physical_sentence_ratio", "transition_sentence_ratio")


# --- scoring -------------------------------------------------------------------------


def _hits_for_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("role").alias("命中关键词"), F.lit("分类").alias("分类"), F.col("text").alias("命中句子"))


def _stub(s: scoring.Scoring):
    n = F.length(F.col("命中句子"))
    return F.to_json(F.struct(*[(n % size).cast("int").alias(k) for k, (_, size, _) in s.fields.items()]))


SQL_KEYS = """h as (select conv_id * 1000 + turn as pos, role, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from conversations)"""
STUB_FIELDS = ", ".join(f"case when n_ok then cast(length(text) % {size} as integer) else -1 end as \"{col}\"" for col, size, _ in scoring.FIELDS.values())


@query(
    "L02_L05_L07_J09_W02_W03_scoring",
    f"""with {SQL_KEYS}, u as (select role, t, min(pos) as first_pos, first(text order by pos) as text from h group by role, t),
    r as (select *, row_number() over (partition by first_pos // 10000 order by first_pos) <= 2 as n_ok from u)
    select h.pos, {STUB_FIELDS.replace("length(text)", "length(r.text)")}, case when n_ok then '成功' else '未分析' end as status from h join r on h.role = r.role and h.t = r.t""",
)
def scoring_cap(spark, sf_dir):
    s = scoring.Scoring(most=2)
    out, _ = scoring.score_hits(_hits_for_scoring(spark, sf_dir).filter("`命中句子` is not null and `命中关键词` is not null"), _stub(s), s, "pos")
    return out.select("pos", *[c for c, _, _ in scoring.FIELDS.values()], F.col("LLM分析状态").alias("status"))


@query(
    "F27_F29_replies",
    """select i, case when ok then case when rel between 0 and 1 then rel else 1 end else -1 end as rel, case when ok then '成功' else '失败' end as status from
    (values (1, 1, true), (2, 7, true), (3, 0, false), (4, 0, true)) t(i, rel, ok)""",
)
def replies(spark, sf_dir):
    rest = '"time":1,"voice":1,"type":1,"cert":1,"quant":1,"tone":1'
    given = [(1, f'{{"rel":1,{rest},"conf":1}}'), (2, f'```json\n{{"rel":7,{rest},"conf":1}}\n```'), (3, f'{{"rel":0,{rest}}}'), (4, f'{{"rel":0,{rest},"conf":1}}')]
    made = scoring.result_columns(F.col("r"), scoring.Scoring())
    return spark.createDataFrame(given, "i int, r string").select("i", made["LLM相关性"].alias("rel"), made["LLM分析状态"].alias("status"))


@query("H05_record_keys", f"""with {SQL_KEYS} select pos, sha1('{{"category": "分类", "keyword": "' || role || '", "model": "m", "sentence": "' || replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}}') as record_key from h""")
def record_keys(spark, sf_dir):
    return _hits_for_scoring(spark, sf_dir).select("pos", scoring.record_key("m").alias("record_key"))


# --- sections ---------------------------------------------------------------------------


@query("F18_F23_sections")
def sections(spark, sf_dir):
    filler = F.concat(F.lit("目录\n第一节 释义......1\n\n第三节 管理层讨论与分析\n一、报告期内经营情况\n"), "han_text", F.lit("\n第四节 公司治理\n以下略。"))
    return section.extract_sections(reports(spark, sf_dir).select("doc_id", filler.alias("text"))).drop("text")


@query("F24_sentence_counts")
def section_counts(spark, sf_dir):
    stem = F.concat_ws("_", F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"), F.lit("2021"), "source")
    r = reports(spark, sf_dir).select(stem.alias("stem"), F.concat("source", F.lit(".txt")).alias("source"), F.lit("utf-8").alias("encoding"), F.lit("success").alias("status"), F.lit("提取成功").alias("message"), F.col("han_text").alias("section"))
    return section.sentence_counts(r.withColumn("text", section.structured_text(r)).select("stem", "source", "encoding", "text"))


# --- order, limits, sets, hashes -----------------------------------------------------------


@query("W01_O03_numbered", "select row_number() over (order by c_mktsegment, c_name) as no, c_mktsegment, c_name from customer")
def numbers(spark, sf_dir):
    return numbered(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name"), "c_mktsegment", "c_name").toDF("no", "c_mktsegment", "c_name")


@query("U01_U02_union", "select c_custkey as k, c_name as name, null as extra from customer union all select s_suppkey, null, s_name from supplier")
def union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("A21_score_histogram", "select cast(length(text) % 5 as integer) as score, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as part from conversations where text is not null group by 1")
def histogram(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null").groupBy((F.length("text") % 5).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
