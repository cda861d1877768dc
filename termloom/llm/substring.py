"""Substring deduplication: words of repeated windows go, the first occurrence stays.

1. Every window of a text is named by an anchor, the group of words with the
   least hash in it; equal windows have equal anchors.  Anchors that occur at
   one place only cannot belong to a repeated window and are dropped, by an
   aggregate and a join.
2. The passages around the other anchors, one for each run of windows with the
   same anchor, are cut out once for each text.  Equal passages are gathered as
   one row with their first occurrence, so that a passage of very many documents
   is one entry of an index.
3. The distinct passages are dealt over shards by anchor.  Each shard builds an
   FM-index of them and streams them through it.  Backward search gives the
   matching statistics: for every place where a whole window is matched, the
   interval of its occurrences and so the first of them.  A passage's first
   occurrence loses the windows that start earlier in another passage, its other
   occurrences all windows that the search has found.
4. The intervals are gathered by text and applied.

No window goes that the index has not found; only whole copies of a text go
without it.  An anchor with very many occurrences is salted: its passages are cut
into single windows, which are dealt over the shards by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks, lean
from termloom.llm._words import UNBLANK, Words, _power_tables, mix
from termloom.llm.fm_index import window_matches
from termloom.session import stage, unstage

#: Bytes of text that a worker looks at together.
PART = 1 << 20
#: Words of an anchor.
GRAM = 5
#: Occurrences from which an anchor's windows are dealt one by one; the result is the same for any number.
HOT = 512
#: Words of the passages that one FM-index holds, about.
SHARD_WORDS = 200_000


def runs(texts: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, place of the anchor, first window, windows) of every run of windows with one anchor."""
    w = Words(texts, UNBLANK)
    n = len(w)
    if n < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = w.hashes()
    up, down = _power_tables(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n], dtype=np.uint64)])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least, at = grams, np.arange(len(grams))
    width, span = 1, window - gram + 1
    while width < span:  # the first least value of every stretch, doubling its length
        step = min(width, span - width)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        width += step
    text = w.of_text()
    inside = text[window - 1 :] == text[: n - window + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    anchor, own = at[starts], text[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
    head = np.flatnonzero(new)
    base = w.first[own[head]]
    return own[head], grams[anchor[head]], anchor[head] - base, starts[head] - base, np.diff(np.concatenate([head, [len(starts)]]))


def _anchors(window: int):
    """(anchor, th, place, n) of the first two places of an anchor in a text; n is 0 but for the first, where it counts them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", PART):
            text, anchor, place, _, _ = runs(texts, window)
            order = np.lexsort((place, anchor, text))
            text, anchor, place = text[order], anchor[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])) if len(text) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([head, [len(text)]]))
            second = head[size > 1] + 1
            take = np.concatenate([head, second])
            n = np.concatenate([size, np.zeros(len(second), np.int64)])
            th = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[take].view(np.int64)), pa.array(th[text[take]]), pa.array(place[take].astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "th", "place", "n"])

    return run


PASSAGE = "anchor long, sid long, hot boolean, none boolean, id long, th long, th2 long, starts array<int>, windows int, passage binary"


def _packed(rows: DataFrame) -> DataFrame:
    """``rows(..., text)`` with the text compressed for a shuffle, as ``packed``."""
    *given, _ = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch, texts in chunks(batches, "text", PART):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(given))], pa.array([press(t) for t in texts], pa.binary())], [*given, "packed"])

    head = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in given)
    return rows.mapInArrow(lean(run), f"{head}packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a bounded size, with the texts of their column ``packed``."""
    full = zstandard.ZstdDecompressor().decompress
    for batch, parts in chunks(batches, "packed", PART // 2):
        yield batch, [full(x) for x in parts]


def _passages(window: int):
    """Rows of PASSAGE, one for each text and distinct passage in it, with all places where it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch, texts in _unpacked(batches):
            text, anchor, _, first, count = runs(texts, window)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            none, ids, th, th2, places = (batch.column(i).to_pylist() for i in range(1, 6))
            anchor = anchor.view(np.int64)
            out: list[tuple] = []
            for t, raw in enumerate(texts):
                known = {x["anchor"]: x["hot"] for x in places[t]}
                words = raw.split()
                seen: dict[bytes, list[int]] = {}
                own = (none[t], ids[t], th[t], th2[t])
                for r in range(bounds[t], bounds[t + 1]):
                    name = int(anchor[r])
                    hot = known.get(name)
                    if hot is None:
                        continue
                    a, k = int(first[r]), int(count[r])
                    for s, m in [(a + j, 1) for j in range(k)] if hot else [(a, k)]:
                        passage = b" ".join(words[s : s + m + window - 1])
                        starts = seen.get(passage)
                        if starts is None:
                            starts = seen[passage] = []
                            out.append((name, digest(passage) - (1 << 63), hot, *own, starts, m, passage))
                        starts.append(s)
            cols = list(zip(*out)) if out else [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "sid", "hot", "none", "id", "th", "th2", "starts", "windows", "passage"])

    return run


def earlier_windows(rows: list[tuple[bool, int, int, int, int, bytes]], window: int) -> tuple[list[list[int]], list[int]]:
    """For (none, id, th, th2, first, passage) rows: the offsets of windows that start earlier in another row, and the number of windows found."""
    number: dict[bytes, int] = {}
    passages = [[number.setdefault(x, len(number) + 1) for x in r[5].split(b" ")] for r in rows]
    order = {k: i for i, k in enumerate(sorted({r[:4] for r in rows}))}
    base = np.array([order[r[:4]] << 31 | r[4] for r in rows])
    out: list[list[int]] = [[] for _ in rows]
    matched = np.zeros(len(rows), np.int64)
    found = window_matches(passages, len(number) + 1, window)
    index, starts = next(found)
    # when each index row's suffix stands in its text, and the first such time of every group of equal windows
    owner = np.searchsorted(starts, index.suffixes, side="right") - 1
    time = np.where(owner >= 0, base[owner] + index.suffixes - starts[owner], np.iinfo(np.int64).max)
    group = index.full[0]
    heads = np.flatnonzero(group == np.arange(len(group)))
    earliest = np.repeat(np.minimum.reduceat(time, heads), np.diff(np.concatenate([heads, [len(group)]])))
    for lane, place, row in found:
        matched[lane] += 1
        late = earliest[row] < base[lane] + place
        for i, p in zip(lane[late].tolist(), place[late].tolist()):
            out[i].append(p)
    return out, matched.tolist()


VERDICT = "anchor long, sid long, none boolean, id long, th long, th2 long, first int, windows int, other boolean, s int, e int"


def _search(window: int):
    """Rows of VERDICT: spans [s, e) that a passage's first occurrence loses, and, as ``other``, passages whose other occurrences go."""
    names = ["anchor", "sid", "none", "id", "th", "th2", "first", "windows", "repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, words = None, 0

        def out(rows):
            found = []
            offsets, matched = earlier_windows([(*r[2:7], r[9]) for r in rows], window)
            for r, own, n in zip(rows, offsets, matched):
                spans: list[list[int]] = []
                for p in sorted(own):
                    if spans and p <= spans[-1][1] - window + 1:
                        spans[-1][1] = p + window
                    else:
                        spans.append([p, p + window])
                found += [(*r[:8], False, r[6] + s, r[6] + e) for s, e in spans]
                if r[8] and n == r[7]:
                    found.append((*r[:8], True, None, None))
            cols = list(zip(*found)) if found else [[]] * 11
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*names[:8], "other", "s", "e"])

        for b in batches:
            for key, row in zip(b.column(0).to_pylist(), zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in [*names, "passage"]))):
                if words > SHARD_WORDS and key != last:
                    yield out(held)
                    held, words = [], 0
                held.append(row)
                last = key
                words += row[7] + window
        if held:
            yield out(held)

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            copy, spans = (batch.column(i).to_pylist() for i in (1, 2))
            n_words, n_removed, sums = [], [], []
            for raw, is_copy, own in zip(texts, copy, spans):
                words = raw.split()
                n = len(words)
                if is_copy and n >= window:
                    words = []
                elif own:
                    kept, at = [], 0
                    for s, e in sorted((x["s"], x["e"]) for x in own):
                        if s > at:
                            kept += words[at:s]
                        at = max(at, e)
                    words = kept + words[at:]
                n_words.append(n)
                n_removed.append(n - len(words))
                sums.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space, as UTF-8) of every row.

    A word goes if a window of ``window`` words over it also starts earlier: in
    a smaller doc_id, or earlier in the same text. Null doc_ids come last; texts
    of the same doc_id go by a hash of the text; rows with the same doc_id and
    text are one document and get one result. Null and empty texts have no words;
    whole texts of any length count. An empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"), "text")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))

    # 1. anchors that are found at more than one place; copies of a text are the same place
    spots = rows.select("text", "th").mapInArrow(lean(_anchors(window)), "anchor long, th long, place int, n int")
    spot = F.xxhash64("th", "place")
    twice = stage(spots.groupBy("anchor").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.sum("n").alias("n")).filter("a <> b").select("anchor", (F.col("n") >= HOT).alias("hot")))
    places = stage(spots.filter("n > 0").select("anchor", "th").join(twice, "anchor").groupBy("th").agg(F.collect_set(F.struct("anchor", "hot")).alias("places")))
    reps = rows.groupBy("th", "th2").agg(F.min(ident).alias("rep"))
    texts = stage(reps.join(places, "th", "left").select("th", "th2", "rep", "places"))
    unstage(twice, places)

    # 2. their passages, and the distinct ones with their first occurrence
    own = _packed(rows).join(texts.filter(F.col("places").isNotNull()), ["th", "th2"]).filter(ident == F.col("rep"))
    passages = stage(own.select("packed", F.col("rep.none").alias("none"), F.col("rep.id").alias("id"), "th", "th2", "places").mapInArrow(lean(_passages(window)), PASSAGE))
    place = F.struct("none", "id", "th", "th2", F.get("starts", 0).alias("first"))
    repeated = (F.count(F.lit(1)) > 1) | (F.max(F.size("starts")) > 1)
    gathered = passages.groupBy("anchor", "sid").agg(F.min(place).alias("at"), repeated.alias("repeated"), F.first(F.struct("hot", "windows", "passage")).alias("x"))
    distinct = gathered.select(F.when(F.col("x.hot"), F.col("sid")).otherwise(F.col("anchor")).alias("key"), "anchor", "sid", "at.*", "x.windows", "repeated", "x.hot", "x.passage").filter("repeated or not hot")

    # 3. what the indexes find
    shards = distinct.repartition(F.col("key")).sortWithinPartitions("key", "anchor", "sid")
    verdicts = stage(shards.drop("hot").mapInArrow(lean(_search(window)), VERDICT))
    earlier = verdicts.filter("not other").select("th", "th2", "s", "e")
    others = verdicts.filter("other").select("anchor", "sid", F.struct("none", "id", "th", "th2", "first").alias("at"))
    start = passages.select("anchor", "sid", "none", "id", "th", "th2", "windows", "starts").join(others, ["anchor", "sid"]).withColumn("first", F.explode("starts"))
    later = start.filter(F.struct("none", "id", "th", "th2", "first") != F.col("at")).select("th", "th2", F.col("first").alias("s"), (F.col("first") + F.col("windows") + (window - 1)).alias("e"))

    # 4. what goes, by text
    spans = later.unionAll(earlier).groupBy("th", "th2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    found = stage(texts.select("th", "th2", "rep").join(spans, ["th", "th2"], "left"))
    unstage(texts, passages, verdicts)
    joined = _packed(rows).join(found, ["th", "th2"]).select("doc_id", (ident != F.col("rep")).alias("copy"), "spans", "packed")
    return joined.mapInArrow(lean(_apply(window)), f"doc_id {kind}, n_words long, n_removed long, kept binary")
