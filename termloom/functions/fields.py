"""Codes, dates, keys and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import BLANK, strip

# Ranges and exchange suffixes.
FIRST_YEAR, LAST_YEAR = 1990, 2030
FIRST_SERIAL, LAST_SERIAL = 20_000, 60_000
SUFFIX = r"(?i)\.(SH|SZ|BJ|NQ|HK|OQ)$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """A double if the text is a plain number, else null."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def zero_fill(c: Column, width: int) -> Column:
    """Like padding with zeros after the sign; longer texts stay."""
    sign = F.when(c.rlike("^[+-]"), F.substring(c, 1, 1)).otherwise("")
    digits = F.regexp_replace(c, "^[+-]", "")
    return F.when(F.length(c) < width, F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))).otherwise(c)


def stock_code(c: Column) -> Column:
    """Six digits from a code with or without exchange suffix or decimals; other texts stay; null gives an empty text."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), SUFFIX, "")
    n = number(s)
    return F.when(n.isNotNull() & (F.abs(n) < 1e18), zero_fill(F.when(n > -1, n).otherwise(n).cast("bigint").cast("string"), 6)).otherwise(s)


def _stamp(s: Column, shape: str, *patterns: str) -> Column:
    return F.when(s.rlike(shape), F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in patterns]))


def moment(s: Column) -> Column:
    """A timestamp from the usual written forms, in UTC; month first where day and month could be swapped. Anything else is null."""
    iso = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    return F.coalesce(
        _stamp(s, iso + "$", "yyyy-M-d"),
        _stamp(s, r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
        _stamp(s, r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$", "yyyy.M.d"),
        _stamp(s, r"^[0-9]{4}[-/][0-9]{1,2}$", "yyyy-M", "yyyy/M"),
        _stamp(s, r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy", "d/M/yyyy"),
        _stamp(s, r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy", "d-M-yyyy"),
        _stamp(s, r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2} [0-9]{1,2}:[0-9]{2}$", "yyyy-M-d H:mm", "yyyy/M/d H:mm"),
        _stamp(s, r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "yyyy-M-d H:mm:ss", "yyyy/M/d H:mm:ss"),
        F.when(s.rlike(iso + "[T ][0-9]{2}:[0-9]{2}"), s.try_cast("timestamp")),
        _stamp(s, r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
        _stamp(s, r"^[A-Z][a-z]+ [0-9]{4}$", "MMMM yyyy", "MMM yyyy"),
    )


def serial_date(n: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))


def _in_years(y: Column) -> Column:
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), y.cast("int"))


def date_parts(c: Column) -> Column:
    """struct(n, s, at) of a cell: its number, its text, and the moment written in it; what the three functions below read."""
    n, s = number(c), strip(c)
    dashed = F.replace(F.replace(F.replace(s, F.lit("年"), F.lit("-")), F.lit("月"), F.lit("-")), F.lit("日"), F.lit(""))
    open_end = F.regexp_replace(dashed, "^((?:19|20)[0-9]{2}-[0-9]{1,2})-$", "$1")
    at = F.when(n.isNull() & ~dashed.rlike("^(?:19|20)[0-9]{2}-?$"), moment(open_end))
    return F.struct(n.alias("n"), s.alias("s"), at.alias("at"))


def year_from(n: Column, s: Column, at: Column) -> Column:
    """The year of the parts of a cell."""
    return F.coalesce(
        F.when(n.between(FIRST_YEAR, LAST_YEAR), n.cast("int")),
        F.when(~s.rlike("[年月日]"), _in_years(F.year(at))),
        _in_years(F.year(serial_date(F.when(F.abs(n) < 100_000, n)))),
        _in_years(F.regexp_extract(s, "((?:19|20)[0-9]{2})", 1).try_cast("int")),
        F.lit(0),
    )


def month_from(n: Column, s: Column, at: Column) -> Column:
    """The month of the parts of a cell."""
    dashed = F.replace(F.regexp_replace(s, "[年月]", "-"), F.lit("日"), F.lit(""))
    written = F.regexp_extract(dashed, r"(?:19|20)[0-9]{2}[^0-9]{1,3}([0-9]{1,2})", 1).try_cast("int")
    return F.coalesce(
        F.when(F.year(at).between(FIRST_YEAR, LAST_YEAR), F.month(at)),
        F.when(n.between(FIRST_SERIAL, LAST_SERIAL), F.month(serial_date(n))),
        F.when(written.between(1, 12), written),
        F.lit(0),
    )


def date_from(n: Column, s: Column) -> Column:
    """The text of the parts of a cell."""
    return F.coalesce(F.when(n.between(FIRST_SERIAL, LAST_SERIAL), F.date_format(serial_date(n), "yyyy-MM-dd")), s, F.lit(""))


def year_of(c: Column) -> Column:
    """The year of a cell: a plain year, a date, a spreadsheet serial, or the first year written in it; 0 if none is from 1990 to 2030."""
    p = date_parts(c)
    return year_from(p["n"], p["s"], p["at"])


def month_of(c: Column) -> Column:
    """The month of a cell, 0 if it cannot be told; a bare year has none."""
    p = date_parts(c)
    return month_from(p["n"], p["s"], p["at"])


def date_text(c: Column) -> Column:
    """The cell as text; spreadsheet serials as ISO dates; null as an empty text."""
    return date_from(number(c), strip(c))


def code_key(c: Column) -> Column:
    """Join key of a code: six digits, or a text for missing ones that matches other missing ones."""
    n = number(c.cast("string"))
    return F.coalesce(zero_fill(n.cast("bigint").cast("string"), 6), F.lit("00<NA>"))


def year_key(c: Column) -> Column:
    return F.coalesce(number(c.cast("string")).cast("bigint").cast("string"), F.lit("<NA>"))


def ratio(over: Column, under: Column) -> Column:
    """Null where ``under`` is null or not above 0."""
    return F.when(under > 0, over / under)


def percent(over: Column, under: Column) -> Column:
    """In hundredths to two places; 0 where ``under`` is 0."""
    return F.when(under != 0, F.round(over / under * 100, 2)).otherwise(F.lit(0.0))


def version_key(c: Column) -> Column:
    """Numbers of a version text, comparable as an array."""
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))


def stem_meta(stem: Column) -> Column:
    """struct(code, year) from a file name: first isolated six digits or the first part, first year anywhere."""
    six = F.regexp_extract(stem, r"(?<!\p{Nd})(\p{Nd}{6})(?!\p{Nd})", 1)
    head = F.get(F.filter(F.split(stem, rf"[_\-]|{BLANK}"), lambda x: x != ""), F.lit(0))
    return F.struct(F.when(six != "", six).otherwise(F.coalesce(head, F.lit(""))).alias("code"), F.regexp_extract(stem, r"((?:19|20)\p{Nd}{2})", 1).alias("year"))


def report_meta(stem: Column, layouts: bool = True) -> Column:
    """struct(code, year, company, title, date) from a file name of parts joined by ``_``.

    With ``layouts`` a name ending in its year is code_company_year; otherwise parts
    go code_year_company_title_date.
    """
    p = F.split(stem, "_")
    n = F.size(p)
    part = lambda i: F.get(p, F.lit(i))
    last = F.element_at(p, -1)
    middle = lambda a, drop: F.array_join(F.slice(p, a, F.greatest(n - drop, F.lit(0))), "_")
    six = F.regexp_extract(stem, r"(?<!\p{Nd})(\p{Nd}{6})(?!\p{Nd})", 1)
    year = F.regexp_extract(stem, r"(?<!\p{Nd})((?:19|20)\p{Nd}{2})(?!\p{Nd})", 1)
    is_year = lambda c: F.coalesce(c.rlike(r"^(?:19|20)\p{Nd}{2}$"), F.lit(False))
    tail = F.lit(layouts) & (n >= 3) & ~is_year(part(1)) & is_year(last)
    name = F.when(tail, strip(middle(2, 2))).when(n >= 3, part(2)).otherwise("")
    title = F.when(tail, F.concat(name, last, F.lit("年年度报告"))).when(n > 4, middle(4, 4)).when(n == 4, part(3)).otherwise("")
    return F.struct(
        F.when(six != "", six).otherwise(part(0)).alias("code"), year.alias("year"), name.alias("company"), title.alias("title"), F.when(~tail & (n >= 4), last).otherwise("").alias("date")
    )
