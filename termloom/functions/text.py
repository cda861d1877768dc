"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks, sentence ends, resplit delimiters, trimmed punctuation, limits.
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same, as characters.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SENTENCE_END = "[。！？!?]"
DELIMITERS = ("；", ";", "，", ",")
TRIMMED = "；;：:，,、 　"
MAX_LEN, MIN_LEN, LEAST_HAN, MOST_NUMERIC = 200, 8, 8, 0.45

# Page furniture. Padding never crosses a line; ``.`` stops at \n only.
PAD = r"[ \t　]*"
PAGE_NUMBER = rf"第?{PAD}\p{{Nd}}{{1,4}}{PAD}页?(?:{PAD}/{PAD}\p{{Nd}}{{1,4}})?"
RUNNING_HEAD = rf".{{0,30}}?\p{{Nd}}{{4}}{PAD}年?{PAD}(?:年度|半年度|度)?{PAD}报告{PAD}(?:全文)?"
PAGE_BLOCK = rf"(?d)\n(?:{PAD}\n)*(?:{PAD}(?:{PAGE_NUMBER}|{RUNNING_HEAD}){PAD}\n(?:{PAD}\n)*)+"
COMPANY = "有限公司"
INLINE_HEAD = rf"[一-龥]{{2,20}}(?:股份)?{COMPANY}{PAD}\p{{Nd}}{{4}}{PAD}年{PAD}年?度?报告全文"
PARAGRAPH = rf"\n{PAD}\n{BLANK}*"


@cache
def digit_class() -> str:
    """Everything Python calls a digit: the decimal digits, and the other digits by rule."""
    others = [i for i in range(0x110000) if chr(i).isdigit() and not chr(i).isdecimal()]
    heads = [i for i in others if i - 1 not in others]
    ends = [i for i in others if i + 1 not in others]
    return r"\p{Nd}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(heads, ends))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Without any blank."""
    return F.regexp_replace(c, BLANK, "")


def collapse(c: Column) -> Column:
    """Blanks to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def lines(c: Column) -> Column:
    """CRLF and CR to LF, NUL removed."""
    return F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\0"), F.lit(""))


def han_count(c: Column, last: str = "龥") -> Column:
    return F.length(F.regexp_replace(c, rf"[^一-{last}]", ""))


def is_table_like(c: Column) -> Column:
    enough_han = c.rlike(rf"^(?:[^一-龥]*+[一-龥]){{{LEAST_HAN}}}")  # stops at the last one needed
    # Han runs, which are never numeric, go first: the long class is slow to try on each of their characters
    numeric = F.regexp_count(F.regexp_replace(c, "[一-龥]++", ""), F.lit(rf"[{digit_class()},.%\-—、|/ ]"))
    return (F.length(c) == 0) | ~enough_han | (numeric / F.length(c) > F.lit(MOST_NUMERIC))


def _pack(c: Column, delimiter: str, max_len: int) -> Column:
    """Pieces between the delimiters, joined again as long as they fit."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        wider = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(delimiter), piece))
        full = (F.length(wider) > max_len) & (acc["open"] != "")
        return F.struct(
            F.when(full, piece).otherwise(wider).alias("open"),
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(F.split(c, rf"\Q{delimiter}\E"), start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def resplit(segments: Column, max_len: int = MAX_LEN) -> Column:
    """Segments over ``max_len`` cut at each delimiter in turn, and what is still too long at every ``max_len`` characters."""

    def at(d: str):
        return lambda s: F.when((F.length(s) > max_len) & s.contains(d), _pack(s, d, max_len)).otherwise(F.array(s))

    def long(segment: Column) -> Column:
        parts = F.array(segment)
        for d in DELIMITERS:
            parts = F.flatten(F.transform(parts, at(d)))
        cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_len).cast("int")), lambda i: F.substring(s, i * max_len + 1, F.lit(max_len)))
        return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) > max_len, cut(s)).otherwise(F.array(s))))

    return F.flatten(F.transform(segments, lambda s: F.when(F.length(s) > max_len, long(s)).otherwise(F.array(s))))


def sentences(c: Column, max_len: int = MAX_LEN, drop_tables: bool = True, compact: bool = False) -> Column:
    """The sentences of a text: page furniture out, broken lines glued, cut at sentence ends, long ones cut further, fragments and tables dropped.

    Null gives an empty array.
    """
    t = lines(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, PAGE_BLOCK, "\n")
    # the pattern tries every run of Han characters, so only where it can match; a transform, so that the text is made once
    t = F.get(F.transform(F.array(t), lambda s: F.when(s.contains(COMPANY), F.regexp_replace(s, INLINE_HEAD, "")).otherwise(s)), F.lit(0))
    t = F.replace(F.regexp_replace(t, PARAGRAPH, "。"), F.lit("\n"), F.lit(""))
    parts = F.filter(F.transform(F.split(t, SENTENCE_END), strip), lambda s: s != "")
    kept = F.filter(F.transform(resplit(parts, max_len), strip), lambda s: F.length(s) >= MIN_LEN)
    if drop_tables:
        kept = F.filter(kept, lambda s: ~is_table_like(s))
    return F.transform(kept, lambda s: F.btrim(squeeze(s), F.lit(TRIMMED))) if compact else kept


def occurrences(c: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of ``keyword`` in ``c`` whatever the case; 0 for an empty keyword."""
    return occurrences_lowered(F.lower(c), F.lower(keyword))


def occurrences_lowered(low: Column, k: Column) -> Column:
    """The same where both are in lower case already."""
    return F.when(F.length(k) > 0, ((F.length(low) - F.length(F.replace(low, k, F.lit("")))) / F.length(k)).cast("long")).otherwise(F.lit(0).cast("long"))


# The table filter of paragraphs.
TABLE_HINT = "单位[:：]|币种|附表|分行业|分产品|分地区|分销售模式|项目名称|药品名称|研发管线|营业收入|营业成本|同比增减|期末余额|期初余额|前五名客户|前五名供应商|按治疗领域|按细分行业"
REPORT_LINE = rf"(?:20\p{{Nd}}{{2}}{BLANK}*年)?年度报告(?:全文)?(?:（.*?）)?"
LINE_END = "[。！？!?；;]$"


def paragraphs(c: Column) -> Column:
    """struct(text, dropped): the text without table-like paragraphs, and how many there were."""
    furniture = lambda s: s.rlike(rf"^(?:\p{{Nd}}+|{REPORT_LINE}|[-_=]{{3,}})$")
    clean = lambda p: F.filter(F.transform(F.split(p, "\n"), collapse), lambda s: (s != "") & ~furniture(s))
    found = F.filter(F.transform(F.split(lines(c), rf"\n{BLANK}*\n+"), clean), lambda p: F.size(p) > 0)
    digits = lambda s: F.length(F.regexp_replace(s, rf"[^{digit_class()}]", ""))
    heavy = lambda s: s.rlike(r"(?U)^[\d\W_]+$") | (digits(s) >= 4) | (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3) | ((F.length(s) <= 12) & (han_count(s, "鿿") <= 8))

    def table(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0), lambda a, s: a + F.length(s))
        n = F.size(p)
        n_heavy = F.size(F.filter(p, heavy))
        shape = F.when(n == 1, (n_heavy == 1) | (total <= 20)).when(n == 2, (total / n <= 18) | (n_heavy >= 1)).otherwise((total / n <= 24) | (n_heavy / n >= 0.2))
        return ~F.exists(p, lambda s: s.rlike(LINE_END)) & (F.exists(p, lambda s: s.rlike(TABLE_HINT)) | shape)

    kept = F.filter(found, lambda p: ~table(p))
    return F.struct(F.array_join(F.transform(kept, lambda p: F.array_join(p, "\n")), "\n\n").alias("text"), (F.size(found) - F.size(kept)).alias("dropped"))


def body_chars(c: Column) -> Column:
    return F.length(squeeze(lines(c)))


# The structured text files.
BODY_MARKER = "===== MDA（管理层讨论与分析）正文 ====="
HEADER_FIELDS = ("公司代码", "年份", "公司名称", "报告标题", "报告日期", "来源文件", "源文件编码", "提取状态", "说明")


def header_field(head: Column, name: str) -> Column:
    """The last value of a header field, or null if the field is not there."""
    every = F.regexp_extract_all(head, F.lit(rf"(?m)(?d)^{name}：(.*)$"), F.lit(1))
    return F.when(F.size(every) > 0, strip(F.element_at(every, -1)))


def split_body(c: Column) -> Column:
    """struct(head, body): around the first body marker; body is null without one."""
    at = F.instr(c, BODY_MARKER)
    return F.struct(
        F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("head"),
        F.when(at > 0, F.substring(c, at + len(BODY_MARKER), F.length(c))).alias("body"),
    )


def without_fences(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, rf"```json{BLANK}*", ""), rf"```{BLANK}*", ""))
