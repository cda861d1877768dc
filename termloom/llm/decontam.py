"""Benchmark decontamination with suffix arrays of the training text.

Each chunk of documents gets a suffix array over its words: the starts of all
suffixes, sorted.  Every suffix of every benchmark item that can begin a window
is binary-searched in it; the range found holds all verbatim occurrences.
Suffixes whose first words are not all words of the benchmark cannot match and
are left out before sorting, so the array is sparse.  Matches are found on word
numbers taken from 64-bit hashes and then compared byte by byte.

The suffixes of the words hit are then ranked to their full depth, by doubling,
together with those of the items found: a suffix's longest verbatim match is with
the one sorted next to it on either side in the other text, and the doubling's
ranks give its length.  Each document gets the longest match it holds and where
it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks, free_name
from termloom.llm._words import ALNUM, Words

#: A larger benchmark is searched for in blocks of about so many bytes.
BLOCK_BYTES = 16 << 20
#: Bytes of documents in a suffix array.
SHARD_BYTES = 2 << 20


@dataclass
class Items:
    """The distinct windows of some benchmark items, ready to be searched for. At most a small multiple of BLOCK_BYTES."""

    window: int
    ids: list[str | None]
    hashes: np.ndarray  # of the distinct words, sorted
    words: list[bytes]  # in the same order
    maybe: np.ndarray  # whether a word has these low bits
    keys: np.ndarray  # the distinct windows, as big-endian word numbers
    length: np.ndarray  # their words
    at: np.ndarray  # window k is in items has[at[k]:at[k + 1]]
    has: np.ndarray
    numbers: np.ndarray  # the items' words one after the other, from 1
    first: np.ndarray  # item i has words first[i]:first[i + 1]


def prepare(items: list[tuple[str | None, bytes]], window: int = 10) -> Items:
    w = Words([text for _, text in items], ALNUM, lower=True)
    h = w.hashes()
    hashes, where, number = np.unique(h, return_index=True, return_inverse=True)
    words = [w.raw[w.starts[i] : w.ends[i]] for i in where.tolist()]
    maybe = np.zeros(1 << 18, dtype=bool)
    maybe[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    n = np.diff(w.first)
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, a + max(k - window, 0) + (k > 0)) for a, k in zip(w.first.tolist(), n.tolist())]])
    item = np.repeat(np.arange(len(items)), np.maximum(n - window, 0) + (n > 0))
    size = np.minimum(n[item], window)
    padded = np.concatenate([number + 1, np.zeros(window, np.int64)]).astype(np.int32)
    table = padded[starts[:, None] + np.arange(window)] * (np.arange(window) < size[:, None])
    keys, which = np.unique(_keys(table), return_inverse=True) if len(starts) else (np.zeros(0, f"S{4 * window}"), np.zeros(0, np.int64))
    pairs = np.unique(np.stack([which, item], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
    at = np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1))
    length = np.zeros(len(keys), np.int64)
    length[which] = size
    return Items(window, [i for i, _ in items], hashes, words, maybe, keys, length, at, pairs[:, 1], padded[: len(number)], w.first)


def _keys(table: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows; zeros at the end do not count."""
    return np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * table.shape[1]}").ravel()


def occurrences(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of an item window in the texts of ``w``, and the words' numbers."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(w), np.int64)
    if not len(w) or not len(items.keys):
        return none
    h = w.hashes()
    maybe = np.flatnonzero(items.maybe[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(items.hashes, h[maybe]), len(items.hashes) - 1)
    known = items.hashes[spot] == h[maybe]
    number = np.zeros(len(w) + items.window, np.int64)
    number[maybe[known]] = spot[known] + 1
    # how many words of the benchmark follow each other from here on, inside the text
    stop = np.ones(len(w) + 1, dtype=bool)
    stop[:-1] = number[: len(w)] == 0
    stops = np.flatnonzero(stop)
    text_end = np.repeat(w.first[1:], np.diff(w.first))
    follow = np.minimum(stops[np.searchsorted(stops, np.arange(len(w)))], text_end) - np.arange(len(w))
    least = int(items.length.min())
    suffix = np.flatnonzero(follow >= least)
    if not len(suffix):
        return none
    table = number[suffix[:, None] + np.arange(items.window)] * (np.arange(items.window) < follow[suffix, None])
    keys = _keys(table)
    order = np.argsort(keys, kind="stable")
    array, suffix = keys[order], suffix[order]
    low = np.searchsorted(array, items.keys, "left")
    high = np.searchsorted(array, items.keys, "right")
    for k in np.flatnonzero(items.length < items.window):  # a short item is the beginning of longer suffixes
        top = items.keys[k].ljust(4 * int(items.length[k]), b"\0") + b"\xff" * 4 * int(items.window - items.length[k])
        high[k] = np.searchsorted(array, np.array([top], dtype=array.dtype), "right")[0]
    n = high - low
    windows = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    first = suffix[rows]
    # the words themselves, in case two share a hash
    sure = np.ones(len(first), dtype=bool)
    seen: dict[int, bool] = {}
    for i, (f, k) in enumerate(zip(first.tolist(), items.length[windows].tolist())):
        for j in range(f, f + k):
            ok = seen.get(j)
            if ok is None:
                ok = seen[j] = w.raw[w.starts[j] : w.ends[j]] == items.words[number[j] - 1]
            if not ok:
                sure[i] = False
    return first[sure], windows[sure], number[: len(w)]


def doubled_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of ``x`` by their first 1, 2, 4, ... numbers, until no two are alike or no run is longer.

    Zeros end a suffix: what follows them plays no part.
    """
    ranks = [x.astype(np.int64)]
    step = 1
    while len(x):
        last = ranks[-1]
        after = np.zeros(len(x), np.int64)
        after[:-step] = last[step:] if step < len(x) else 0
        after[last == 0] = 0
        if not after.any():
            break
        seen, new = np.unique(last * (int(last.max()) + 1) + after, return_inverse=True)
        ranks.append(new if len(seen) and seen[0] == 0 else new + 1)
        step *= 2
    return ranks


def longest_matches(w: Words, items: Items, number: np.ndarray, hit: np.ndarray, some: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """text: (words, first word of the match in the text, item, its first word in the item) of each text's longest verbatim match.

    Of equal matches the first in the text counts, then that of the first item
    and place. Only the words ``hit``, and the items ``some`` of which a window
    was found, can be in a match as long as a window.
    """
    spots = np.flatnonzero(hit)
    if not len(spots):
        return {}
    text = np.searchsorted(w.first, spots, side="right") - 1
    breaks = (np.diff(spots) > 1) | (np.diff(text) > 0)
    # the runs of hit words, then the items, with a zero after each
    place = np.arange(len(spots)) + np.concatenate([[0], np.cumsum(breaks)])
    train = np.zeros(place[-1] + 2, np.int64)
    train[place] = number[spots]
    n = len(train)
    back = np.zeros(n, np.int64)
    back[place] = spots
    size = np.diff(items.first)[some]
    item = np.repeat(some, size)
    inner = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(item)) + np.repeat(np.arange(len(some)), size)
    test = np.zeros(len(item) + len(some) + 1, np.int64)
    test[at] = items.numbers[items.first[item] + inner]
    ranks = doubled_ranks(np.concatenate([train, test]))
    rank = ranks[-1]
    array = place[np.argsort(rank[place], kind="stable")]  # the training suffixes, sorted
    best: dict[int, tuple[int, int, int, int]] = {}
    tests = n + at[np.argsort(rank[n + at], kind="stable")]
    spot = np.searchsorted(rank[tests], rank[array])
    found = []
    for shift in (-1, 0):
        k = spot + shift
        ok = (k >= 0) & (k < len(tests))
        found.append((array[ok], tests[k[ok]]))
    p, q = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    length = np.zeros(len(p), np.int64)
    a, b = p.copy(), q.copy()
    for level in range(len(ranks) - 1, -1, -1):
        same = (ranks[level][a] == ranks[level][b]) & whole(ranks, level, a) & whole(ranks, level, b)
        a, b, length = a + (same << level), b + (same << level), length + (same << level)
    own = np.searchsorted(w.first, back[p], side="right") - 1
    order = np.lexsort((q, p, -length, own))
    new = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])]
    for i in new.tolist():
        j = int(np.searchsorted(at, q[i] - n))
        best[int(own[i])] = (int(length[i]), int(back[p[i]] - w.first[own[i]]), int(item[j]), int(inner[j]))
    return best


def whole(ranks: list[np.ndarray], level: int, i: np.ndarray) -> np.ndarray:
    """Whether the suffixes at ``i`` have as many numbers as a rank of the level looks at, before a zero."""
    end = i + (1 << level) - 1
    stops = np.flatnonzero(ranks[0] == 0)
    return stops[np.minimum(np.searchsorted(stops, i), len(stops) - 1)] > end


def find(texts: list[bytes], items: Items) -> list[tuple[int, list[int], list[int], tuple[int, int, int, int]]]:
    """For each text its number of words, the hit words as flat [start, end) ranges, the items found, and the longest match."""
    w = Words(texts, ALNUM, lower=True)
    first, windows, number = occurrences(w, items)
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + items.length[windows], -1)
    covered = np.cumsum(change)[:-1] > 0
    known = np.unique(windows)
    some = np.unique(np.concatenate([np.zeros(0, np.int64), *[items.has[items.at[k] : items.at[k + 1]] for k in known.tolist()]]))
    longest = longest_matches(w, items, number, covered, some)
    hit = np.concatenate([[0], covered.astype(np.int8), [0]])
    out = [(n, [], [], longest.get(t, (0, -1, -1, -1))) for t, n in enumerate(np.diff(w.first).tolist())]
    text = np.searchsorted(w.first, first, side="right") - 1
    for t in np.unique(text).tolist():
        a, b = w.first[t], w.first[t + 1]
        own = np.concatenate([[0], hit[1 + a : 1 + b], [0]])
        edges = np.flatnonzero(own[1:] != own[:-1])
        out[t][1].extend(edges.tolist())
    pairs = np.unique(np.stack([text, windows], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    for t, k in pairs.tolist():
        out[t][2].extend(items.has[items.at[k] : items.at[k + 1]].tolist())
    return [(n, r, sorted(set(i)), m) for n, r, i, m in out]


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``most`` bytes; the driver holds one or two of them at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).orderBy("i", "t")
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row.t) > most:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += len(row.t)
    yield block


#: Columns that are added.
OWN = {"n_words": "long", "hit_ranges": "array<long>", "items": "array<string>", "longest": "long", "longest_at": "long", "longest_item": "string", "longest_item_at": "long"}


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with those of OWN.

    hit_ranges holds flat [start, end) ranges of the words inside an occurrence
    of a window; items the item_ids of which a window occurs, as strings in
    order. longest is the words of the longest verbatim match with an item (0
    without hits), longest_at and longest_item_at where it begins in the text
    and in the item longest_item; of equal ones the first in the text counts,
    then that of the first item by id and text. Null and empty texts, and items without words,
    have no windows; items of a null item_id count as hits but are not listed.
    Whole texts of any length are searched. Repeated rows stay repeated; an empty
    table gives no rows; an empty benchmark hits nothing. Columns named like
    those of OWN are replaced.

    The documents are read once, whatever the benchmark's size: each chunk meets
    the blocks of the benchmark one after the other, of which a worker holds one.
    """
    docs = docs.drop(*OWN)
    keep = docs.columns if keep is None else keep
    (raw,) = free_name(docs, "__raw")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*keep, F.col("text").cast("binary").alias(raw))
    blocks = [docs.sparkSession.sparkContext.broadcast(prepare(block, window)) for block in _blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # larger chunks for more blocks, as each chunk loads them all
        for batch, texts in chunks(batches, raw, SHARD_BYTES * min(len(blocks), 16)):
            found: list[list] = []
            for block in blocks:
                known = block.value
                new = [[n, r, {known.ids[i] for i in own if known.ids[i] is not None}, m[0], m[1], known.ids[m[2]] if m[0] else None, m[3]] for n, r, own, m in find(texts, known)]
                if found:
                    for a, b in zip(found, new):
                        a[1], a[2] = _merged(a[1], b[1]), a[2] | b[2]
                        if (b[3], -b[4]) > (a[3], -a[4]):
                            a[3:] = b[3:]
                else:
                    found = new
                if len(blocks) > 1:
                    del known
                    block.__dict__.pop("_value", None)  # one block in a worker's memory at a time
            for a in found:
                a[2] = sorted(a[2])
            given = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*given, *(pa.array([a[i] for a in found], kind) for i, kind in enumerate(made))], [*keep, *OWN])

    fields = [f"`{c}` {kinds[c]}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{c} {kind}" for c, kind in OWN.items())]))


def n_hit():
    """The number of hit words, from hit_ranges."""
    at = F.sequence(F.lit(0), F.size("hit_ranges") - 1)
    return F.when(F.size("hit_ranges") > 0, F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s + F.when(i % 2 == 0, -F.get("hit_ranges", i)).otherwise(F.get("hit_ranges", i)))).otherwise(F.lit(0).cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit word, with their columns; null and empty texts stay, repeated rows stay repeated."""
    (ranges,) = free_name(docs, "__ranges")
    names = docs.columns
    put_by = {c: f"{c}{ranges}" for c in names if c.lower() in OWN}
    marked = mark_contaminated(docs.withColumnsRenamed(put_by), benchmark, window)
    clean = marked.filter(F.size("hit_ranges") == 0).drop(*OWN)
    return clean.withColumnsRenamed({v: k for k, v in put_by.items()}).select(*names)
