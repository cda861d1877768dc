"""Near copies by exact Jaccard similarity of word shingles: SimHash links first, then a prefix filter that loses none.

A text is the set of its shingles' hashes.  Fingerprints at most two bits apart
are found by the byte-position index of ``simhash`` and their sets compared
exactly; that joins most groups of copies, but at a similarity of 0.8 two
fingerprints of 64 bits differ in about ten, far too many for any index with
useful lists.  The rest is found by prefix filtering: all sets are put in one
total order; two sets of similarity ``s`` or more then share an element among
the first ``n - ceil(s * n) + 1`` of each, so an index of these prefixes meets
every such pair.  The order is free: shingles that a sample shows to be common
come last, which keeps lists short.  What follows the first common element in
either set bounds the intersection, so a list pairs an element only with sets
that its place in both still allows.  Of the pairs left, those go whose parity
sketches differ in more bits than their sets may in elements, which no pair of
similarity ``s`` can; the others are verified by the size of the intersection.

A group of n near copies would give n * n / 2 candidates.  Each set is therefore
first compared with the one list head it meets most often; the head of a list is
its set with the most widely shared elements, as a text that many others were
made from has.  Pairs that these links already join, and lists that hold one
group only, need no comparison.  Sets
that share a long passage but too little besides have their common elements too
late to be paired, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks
from termloom.llm._words import UNBLANK, Words, _power_tables, mix
from termloom.llm.components import components
from termloom.llm.simhash import SENT, keep_first, links
from termloom.session import stage, unstage

SEED = 42
#: Bytes of text that a worker makes shingles of at a time; the numbers made of them take some fifty times as much.
PART = 1 << 20
#: Documents in which common shingles are looked for, and how many of these are kept.
SAMPLE = 20_000
COMMON = 1 << 18
#: Bits that the fingerprints of the first links may differ in.
BITS = 2


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each text the distinct hashes of its word shingles, A-Z lower-cased, ascending; a shorter text is one shingle."""
    w = Words(texts, UNBLANK, lower=True)
    n = len(w)
    up, down = _power_tables(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hashes() * up[:n], dtype=np.uint64)])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        last = max(b - words, a) + 1 if b > a else a
        size = min(words, b - a)
        out.append(np.unique(mix((sums[a + size : last + size] - sums[a:last]) * down[a:last])))
    return out


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray, s: Fraction) -> np.ndarray:
    """The first ``n - ceil(s * n) + 1`` of the ascending hashes, those of the ascending ``common`` last by their count."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, count[at], 0)
    return found[np.argsort(rank, kind="stable")][: n - -(-s.numerator * n // s.denominator) + 1]


def print_of(found: np.ndarray) -> int:
    """The SimHash of a set: the bits set in over half of its hashes."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls in each of two to four times as many slots as there are hashes.

    Each element that only one of two sets has changes one bit, so two sketches
    differ in no more bits than the sets in elements.
    """
    slots = 2 << max(32, len(found)).bit_length()
    odd = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits in which two sketches differ; the longer is folded to the slots of the shorter."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """``pairs(a, b)`` without those whose sketches show that their sets differ in too many elements."""
    most = Fraction(s.denominator - s.numerator, s.denominator + s.numerator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            ok = pa.array([differing(x[i], y[i]) * most.denominator <= (n[i] + m[i]) * most.numerator for i in range(len(a))], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    x, y = (sets.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _names(found: list[np.ndarray]) -> list[pa.Array]:
    """128 bits that name each set, as two longs."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in found), dtype="<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(raw[:, i])) for i in (0, 1)]


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most documents of a sample share, ascending, and their counts. They order the prefixes; any choice gives the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in chunks(batches, "text", PART):
            g, c = np.unique(np.concatenate(shingle_sets(part, words)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c)], ["g", "c"])

    n = texts.count()
    some = texts if n <= SAMPLE else texts.sample(SAMPLE / n, SEED)
    seen = some.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    rows = seen.filter("c > 1").orderBy(F.desc("c")).limit(COMMON).toArrow()
    g, c = rows["g"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, s: Fraction) -> DataFrame:
    """Those of ``pairs(a, b)`` of set numbers whose sets have a similarity of ``s`` or more."""
    pairs = stage(_possible(pairs, sets, s))
    need = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    need = stage(sets.join(need, "sid", "left_semi").select("sid", "s1", "s2", "h"))
    # keys are small: sent to all tasks, they keep texts that nothing meets from being shuffled
    small = need.count() <= SENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text", PART):
            found = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([*_names(found), _lists(found)], ["s1", "s2", "g"])

    known = need.select("h").distinct()
    wanted = docs.join(F.broadcast(known) if small else known, "h", "left_semi").select("text")
    full = wanted.mapInArrow(run, "s1 long, s2 long, g array<long>").join(F.broadcast(need) if small else need, ["s1", "s2"]).dropDuplicates(["sid"])
    full = stage(full.select("sid", "g"))
    a, b = (full.select(F.col("sid").alias(k), F.col("g").alias(f"g{k}")) for k in "ab")
    met = F.size(F.array_intersect("ga", "gb")) * F.lit(s.numerator + s.denominator)
    out = stage(pairs.join(a, "a").join(b, "b").filter(met >= (F.size("ga") + F.size("gb")) * s.numerator).select("a", "b"))
    unstage(pairs, need, full)
    return out


def _enough(c: str, x: str, y: str, s: Fraction) -> Column:
    """Whether sets of x and y elements with c common ones in their prefixes can reach ``s``.

    Of the set whose prefix ends first all common elements are in both prefixes
    or in its own rest, so no more than c and the longer rest are common.
    """
    p, q = s.numerator, s.denominator
    low, high = F.least(x, y), F.greatest(x, y)
    return (low * q >= high * p) & ((F.col(c) + F.ceil(high * p / q) - 1) * (p + q) >= (low + high) * p)


def similar(sets: DataFrame, docs: DataFrame, words: int, s: Fraction) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the staged ``sets(sid, s1, s2, h, n, f, odd, g)`` of similarity ``s`` or more.

    f is a set's fingerprint, odd its sketch, g its prefix; ``docs(h, text)`` has a text of every set.
    """
    # fingerprints: sets of one print hang on its first set, near prints are joined by their first sets
    prints = stage(sets.groupBy(F.col("f").alias("fingerprint")).agg(F.min("sid").alias("head")))
    same = sets.select("sid", F.col("f").alias("fingerprint")).join(prints, "fingerprint").filter("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    x, y = (prints.select(F.col("fingerprint").alias(k), F.col("head").alias(f"head_{k}")) for k in "xy")
    close = links(prints.select("fingerprint"), BITS).distinct().toDF("x", "y").join(x, "x").join(y, "y").select(F.col("head_x").alias("a"), F.col("head_y").alias("b"))
    # prefixes: lists of several sets
    posts = sets.select("sid", F.col("n").cast("int").alias("n"), F.size("g").alias("k"), F.posexplode("g").alias("at", "g"))
    shared = posts.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    posts = stage(posts.join(shared, "g"))
    score = posts.groupBy("sid").agg((F.sum("c") / F.first("k")).alias("score"))
    heads = stage(posts.join(score, "sid").groupBy("g").agg(F.max(F.struct("score", "sid", "n"))["sid"].alias("head")))
    m = sets.select(F.col("sid").alias("head"), F.col("n").cast("int").alias("m"))
    tally = posts.join(heads, "g").filter("sid <> head").groupBy("sid", "n", "head").agg(F.count(F.lit(1)).alias("c")).join(m, "head")
    most = tally.filter(_enough("c", "n", "m", s)).groupBy(F.col("sid").alias("a")).agg(F.max(F.struct("c", "head")).alias("b")).select("a", "b.head")
    first = _verified(same.unionAll(close).unionAll(most).distinct(), sets, docs, words, s)
    group = stage(components(first)).withColumnsRenamed({"node": "sid"})
    named = posts.drop("k", "c").join(group, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = named.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("g")
    left = stage(named.join(mixed, "g"))
    unstage(prints, posts, heads)
    # x is the smaller set: of its first common element on, it must hold what a partner of its own size needs
    p, q = s.numerator, s.denominator
    x, y = (left.select("g", *[F.col(c).alias(f"{c}_{k}") for c in ("sid", "n", "root")], (F.col("n") - F.col("at")).alias(f"rest_{k}")) for k in "xy")
    x = x.filter(F.col("rest_x") * (p + q) >= F.col("n_x") * (2 * p))
    smaller = (F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("sid_x") < F.col("sid_y"))
    allowed = (F.col("n_x") * q >= F.col("n_y") * p) & (F.least("rest_x", "rest_y") * (p + q) >= (F.col("n_x") + F.col("n_y")) * p)
    more = x.join(y, "g").filter((F.col("root_x") != F.col("root_y")) & smaller & allowed).select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct()
    found = stage(first.unionAll(_verified(more, sets, docs, words, s)))
    unstage(left, first)
    return found


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Which row stays is as in ``drop_near_duplicates``; null and empty texts are
    equal; of rows with one doc_id and text one stays; ties go by a hash of the
    text. Whole texts of any length count; an empty table stays empty; other
    columns, whatever their names, are kept as they are.
    """
    s = Fraction(str(similarity))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(_common(keyed.select("text"), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = held.value
        for batch, texts in chunks(batches, "text", PART):
            found = shingle_sets(texts, words)
            made = [*_names(found), pa.array([len(x) for x in found], pa.int64()), pa.array([print_of(x) for x in found], pa.int64())]
            made += [pa.array([sketch(x) for x in found], pa.binary()), _lists([prefix(x, common, count, s) for x in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "h", "s1", "s2", "n", "f", "odd", "g"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(keyed.mapInArrow(run, f"doc_id {kind}, h long, s1 long, s2 long, n long, f long, odd binary, g array<long>"))
    # one row a set, numbered; the numbers hold since the table is written
    sets = stage(rows.groupBy("s1", "s2").agg(F.first(F.struct("h", "n", "f", "odd", "g")).alias("x")).select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "x.*"))
    linked = stage(components(similar(sets, keyed.select("h", "text"), words, s)))
    named = rows.select("doc_id", "h", "s1", "s2").join(sets.select("sid", "s1", "s2"), ["s1", "s2"])
    roots = stage(named.join(linked, named["sid"] == linked["node"], "left").select("doc_id", "h", F.coalesce("root", "sid").alias("root")))
    unstage(rows, sets, linked)
    return keep_first(docs, roots)
