"""Matching keywords with texts.

Every keyword is counted for itself, also inside a longer one, so an alternation
pattern cannot count them; it may only rule sentences out.  Up to a bound on the
dictionary the match is a broadcast join on containment, which stays in the JVM;
larger dictionaries go through an automaton that finds all keywords in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import occurrences_lowered

#: Keywords that a broadcast join compares with every sentence. The dictionary is counted before it is broadcast.
MOST_COMPARED = 50
#: Words of a list that a broadcast hash join looks tokens up in; a longer list is shuffled.
MOST_BROADCAST = 100_000


def explode_sentences(df: DataFrame, sentences: str = "sentences") -> DataFrame:
    """A row a sentence, with sent_no from 0."""
    rest = [c for c in df.columns if c != sentences]
    # the outer form: the inner one would make the sentences once more to filter out empty arrays
    return df.select(*rest, F.posexplode_outer(sentences).alias("sent_no", "sentence")).filter(F.col("sentence").isNotNull())


def hits(sentences: DataFrame, keywords: list[str], column: str = "sentence", keep: bool = False, most: int = MOST_COMPARED) -> DataFrame:
    """``sentences`` joined with each keyword found in it and its count ``n``, ignoring case.

    With ``keep`` a sentence without any (or a null one) stays, with a null
    keyword and 0. Both ways lower-case with the same JVM function, so the
    result does not depend on the size of the dictionary.
    """
    words = sorted(set(keywords))
    if any("\n" in w for w in words):
        raise ValueError("a keyword may not hold a line break")
    spark = sentences.sparkSession
    small = spark.createDataFrame([(w,) for w in words], "keyword string").withColumn("__low", F.lower("keyword"))
    found = sentences.withColumn("__text", F.lower(column))
    if len(words) > most:
        return _automaton(found, [(r.keyword, r["__low"]) for r in small.toLocalIterator()], keep)
    found = found.join(F.broadcast(small), F.col("__text").contains(F.col("__low")), "left" if keep else "inner")
    n = occurrences_lowered(F.col("__text"), F.col("__low"))
    return found.withColumn("n", F.coalesce(n, F.lit(0).cast("long")) if keep else n).drop("__text", "__low")


def holding(sentences: DataFrame, keywords: list[str], column: str = "sentence") -> DataFrame:
    """The distinct rows of ``sentences`` that hold any keyword, ignoring case as ``hits`` does."""
    words = sorted(set(keywords))
    if len(words) > MOST_COMPARED:
        return hits(sentences, words, column).select(*sentences.columns).distinct()
    low = sentences.sparkSession.createDataFrame([(w,) for w in words], "__low string").select(F.lower("__low").alias("__low"))
    found = sentences.withColumn("__text", F.lower(column)).join(F.broadcast(low), F.col("__text").contains(F.col("__low")), "left_semi")
    return found.drop("__text").distinct()


def _automaton(sentences: DataFrame, words: list[tuple[str, str]], keep: bool) -> DataFrame:
    """The same by an automaton of (keyword, lower-cased) pairs over the lower-cased ``__text``."""
    held = sentences.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        same: dict[str, list[str]] = {}
        for w, low in held.value:
            same.setdefault(low, []).append(w)
        automaton = ahocorasick.Automaton()
        for low in same:
            automaton.add_word(low, low)
        automaton.make_automaton()
        for batch in batches:
            rows, names, counts = [], [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("__text")).to_pylist()):
                ends: dict[str, int] = {}
                n: dict[str, int] = {}
                for end, low in automaton.iter(text or ""):
                    if end - len(low) >= ends.get(low, -1):
                        ends[low] = end
                        n[low] = n.get(low, 0) + 1
                for low, k in n.items():
                    for w in same[low]:
                        rows.append(i)
                        names.append(w)
                        counts.append(k)
                if keep and not n:
                    rows.append(i)
                    names.append(None)
                    counts.append(0)
            taken = batch.take(pa.array(rows, pa.int64())).drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names, pa.string()), pa.array(counts, pa.int64())], [*taken.schema.names, "keyword", "n"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.drop("__text").schema], "keyword string", "n long"])
    return sentences.mapInArrow(run, schema)


Tokenizer = Callable[[str], list[str]]


#: Bytes of text whose tokens a Python worker holds at a time: each is an object of some 80 bytes, and there may be one a character.
TOKENIZED = 1 << 20


def longest_match(words: list[str]) -> Tokenizer:
    """A tokenizer for texts without blanks: at each place the longest known word, else one character; Latin runs stay whole."""
    import re

    known = {w for w in words if len(w) > 1}
    sizes: dict[str, list[int]] = {}
    for w in sorted(known, key=len, reverse=True):
        of = sizes.setdefault(w[0], [])
        if len(w) not in of:
            of.append(len(w))
    # characters that start neither a word nor a Latin run are one token each
    starts = re.compile(f"[A-Za-z0-9{''.join(map(re.escape, sizes))}]")
    latin = re.compile(r"[A-Za-z0-9]+")

    def words_of(text: str) -> Iterator[tuple[int, str]]:
        """Known words and Latin runs with their places; the characters between are one token each."""
        found = starts.search(text)
        while found:
            i = found.start()
            w = next((w for k in sizes.get(text[i], ()) if (w := text[i : i + k]) in known), None)
            m = None if w else latin.match(text, i)
            w = w or (m[0] if m else None)
            if w:
                yield i, w
            found = starts.search(text, i + len(w or " "))

    def cut(text: str) -> list[str]:
        out: list[str] = []
        end = 0
        for i, w in words_of(text):
            out += text[end:i]
            out.append(w)
            end = i + len(w)
        out += text[end:]
        return out

    def keeping(only: frozenset[str]) -> Tokenizer:
        """The tokenizer that gives the tokens of ``only``, without a list of the others."""
        if not any(len(w) == 1 for w in only):
            return lambda text: [w for _, w in words_of(text) if w in only]

        def kept(text: str) -> list[str]:
            out: list[str] = []
            end = 0
            for i, w in words_of(text):
                out += [c for c in text[end:i] if c in only]
                if w in only:
                    out.append(w)
                end = i + len(w)
            out += [c for c in text[end:] if c in only]
            return out

        return kept

    cut.keeping = keeping
    return cut


def tokens(df: DataFrame, column: str, tokenizer: Tokenizer | None = None, only: list[str] | None = None) -> DataFrame:
    """``df`` with ``tokens``; at blanks by default, natively, else by ``tokenizer`` in Arrow batches.

    With ``only``, those of a tokenizer that are not of this list are left out where they are made.
    """
    if tokenizer is None:
        return df.withColumn("tokens", F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda t: t != ""))
    wanted = None if only is None else frozenset(only)
    most = TOKENIZED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        keeping = getattr(tokenizer, "keeping", lambda only: lambda text: [w for w in tokenizer(text) if w in only])
        make = tokenizer if wanted is None else keeping(wanted)
        for b in batches:
            at = b.schema.get_field_index(column)
            size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_pylist()
            start = 0
            while start < b.num_rows:
                stop, held = start + 1, size[start]
                while stop < b.num_rows and held + size[stop] <= most:
                    held += size[stop]
                    stop += 1
                part = b.slice(start, stop - start)
                made = [make(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.string()))], [*b.schema.names, "tokens"])
                start = stop

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "tokens array<string>"])
    return df.mapInArrow(run, schema)


def token_hits(df: DataFrame, keywords: list[str], ids: list[str], stopwords: frozenset[str] | None = None) -> DataFrame:
    """ids, keyword, n: whole tokens that are keywords, exactly, stopwords left out first. Needs ``tokens``."""
    spark = df.sparkSession
    each = df.select(*ids, F.explode("tokens").alias("keyword"))
    if stopwords:
        each = each.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(stopwords)], "keyword string")), "keyword", "left_anti")
    words = spark.createDataFrame([(w,) for w in sorted(set(keywords))], "keyword string")
    words = F.broadcast(words) if len(set(keywords)) <= MOST_BROADCAST else words
    return each.join(words, "keyword", "left_semi").groupBy(*ids, "keyword").agg(F.count(F.lit(1)).alias("n"))


# Words and marks that token counting may leave out.
STOPWORDS = frozenset(
    (
        "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
        "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "这个", "那个", "那", "什么", "如果", "但是", "因为", "所以",
        "可以", "已经", "而且", "或者", "虽然", "这些", "那些", "只是", "但", "而", "及", "与", "以", "为", "之", "其", "中", "对", "被", "从",
        "把", "将", "向", "个", "各", "等", "则", "能", "又", "该", "于", "当", "更", "还", "让", "用", "过", "后", "前", "下",
        "两", "所", "没", "这样", "那样", "怎么", "并", "给", "最", "些", "比", "做", "第", "如", "即", "且", "每", "应", "您", "哪",
        "得", "使", "才", "再", "还是", "及其", "以及", "因此", "由于", "其中", "可能", "已", "此", "需要", "通过", "进行", "不是", "如何", "或", "之间",
    )
) | frozenset(" \t\n\r，。、：；？！'（）【】《》—…·,.:;?!()[]{}-_/\\|@#%&*")


def load_stopwords(path: str) -> frozenset[str]:
    """One word a line, together with the words above."""
    from pathlib import Path

    raw = Path(path).read_bytes()
    for encoding in ("utf-8-sig", "gb18030", "big5"):
        try:
            return STOPWORDS | {w.strip() for w in raw.decode(encoding).splitlines() if w.strip()}
        except UnicodeDecodeError:
            continue
    raise ValueError(f"unknown encoding: {path}")
