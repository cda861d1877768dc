"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints at most ``bits`` bits apart differ in at most ``bits`` of
their eight bytes, so they share at least ``8 - bits`` bytes at the same places:
that is the guaranteed minimum a pair's tally must reach.  Posting lists of
single bytes would hold 1/256 of all fingerprints each, and tallying all their
pairs would cost the square of the corpus.  The eight places are therefore put
in ``bits + 2`` groups, of which such a pair shares two at least; the index is
kept by every two groups, and a pair is tallied in the lists where it meets.

In a list the shared bytes of every pair are tallied over all eight places,
pairs under the minimum go, and the others are verified by their exact distance.
Long lists are cut again by every choice of ``8 - bits`` places, so that the
minimum is reached by meeting there; what is then still long is joined without
making pairs.  A list of n fingerprints gives at most n - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks, free_name
from termloom.llm.components import components
from termloom.session import stage, unstage

SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of the text's word shingles, A-Z lower-cased; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            f = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], ["doc_id", "fingerprint"])

    rows = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def masks(bits: int) -> list[int]:
    """The masks that keep ``8 - bits`` of the eight bytes."""
    return [sum(0xFF << (8 * i) for i in places) for places in combinations(range(8), 8 - bits)]


def list_masks(bits: int) -> list[int]:
    """The masks of the posting lists: every two of ``bits + 2`` groups of byte places."""
    groups = [sum(0xFF << (8 * i) for i in range(g, 8, bits + 2)) for g in range(bits + 2)]
    return [a | b for a, b in combinations(groups, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tally of bytes that fingerprints share at the same places."""
    return (np.ascontiguousarray(x ^ y).view(np.uint8).reshape(*np.broadcast_shapes(x.shape, y.shape), 8) == 0).sum(axis=-1)


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Pairs whose tally reaches the guaranteed minimum and whose distance is ``bits`` at most."""
    found = shared_bytes(x, y) >= 8 - bits
    found[found] = np.bitwise_count((x ^ y)[found]) <= bits
    return found


def _pairs(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs, looked for in strips of bounded size."""
    strip = max(1, (1 << 20) // len(members))
    out = []
    for i in range(0, len(members), strip):
        a, b = np.nonzero(near(members[i : i + strip, None], members[None, :], bits))
        out.append((a[a + i < b] + i, b[a + i < b]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _meetings(members: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the members at most two bits of ``free`` apart: those that meet in a value one bit or none away from each."""
    flips = np.array([0, *(1 << k for k in range(64) if free >> k & 1)], dtype=np.uint64)
    _, met = np.unique((members[:, None] ^ flips[None, :]).ravel(), return_inverse=True)
    order = np.argsort(met, kind="stable")
    who, met = order // len(flips), met[order]
    same = met[1:] == met[:-1]
    return who[:-1][same], who[1:][same]


def link_list(members: np.ndarray, bits: int, most: int = 1024) -> np.ndarray:
    """The least member of each of the ascending members' components, where members at most ``bits`` bits apart are linked.

    ``most`` is the length from which a list is cut again; the result is the same for any.
    """
    n = len(members)
    if n <= most:
        found = [_pairs(members, bits)]
    else:
        found = []
        for mask in masks(bits):
            key = members & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, [n]])
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            found.append((order[two], order[two + 1]))
            found[-1] = tuple(x[near(members[found[-1][0]], members[found[-1][1]], bits)] for x in found[-1])
            for i in np.flatnonzero(size > 2).tolist():
                part = order[edges[i] : edges[i + 1]]
                a, b = _meetings(members[part], ~mask & (1 << 64) - 1) if bits == 2 and len(part) > most else _pairs(members[part], bits)
                found.append((part[a], part[b]))
    a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return members[root]
        root = new


def _links(bits: int):
    kept = np.array(list_masks(bits), dtype=np.uint64)

    def finish(k: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = f & kept[k]
        new = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], new, [len(k)]])
        size = np.diff(edges)
        pairs = edges[:-1][size == 2]
        x, y = f[pairs], f[pairs + 1]
        ok = near(x, y, bits)
        yield np.maximum(x[ok], y[ok]), np.minimum(x[ok], y[ok])
        for i in np.flatnonzero(size > 2):
            members = np.unique(f[edges[i] : edges[i + 1]])
            root = link_list(members, bits)
            other = members != root
            yield members[other], root[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k0, f0 = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(k, f):
            found = list(finish(k, f)) if len(k) else []
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([k0, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
            f = np.concatenate([f0, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if not len(k):
                continue
            last = (k == k[-1]) & (f & kept[k] == f[-1] & kept[k[-1]])
            cut = len(k) - int(last[::-1].argmin()) if not last.all() else 0  # rows before the last list
            yield out(k[:cut], f[:cut])
            k0, f0 = k[cut:], f[cut:]
        yield out(k0, f0)

    return run


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct ``prints(fingerprint)`` at most ``bits`` (0 to 6) apart."""
    if bits not in range(7):
        raise ValueError("bits must be 0 to 6: beyond that no two groups of bytes are sure to be shared")
    keys = [F.struct(F.lit(i).cast("smallint").alias("k"), F.col("fingerprint").alias("f"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("kept")) for i, m in enumerate(list_masks(bits))]
    postings = prints.select(F.inline(F.array(*keys)))
    lists = postings.repartition(F.col("k"), F.col("kept")).sortWithinPartitions("k", "kept", "f").select("k", "f")
    return lists.mapInArrow(_links(bits), "a long, b long")


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """(fingerprint, root, component_id) of every fingerprint of the staged ``rows(doc_id, fingerprint)``."""
    prints = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    linked = stage(components(links(prints, bits)))
    least = stage(linked.join(prints, linked["node"] == prints["fingerprint"]).groupBy("root").agg(F.min("first").alias("least")))
    named = linked.join(least, "root")
    labels = prints.join(named, prints["fingerprint"] == named["node"], "left")
    # staged, so that the join with the documents can split a fingerprint that very many share
    out = stage(labels.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.least("first", "least").alias("component_id")))
    unstage(prints, linked, least)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that can be reached over links of at
    most ``bits`` differing bits, the row's own included; it is null if every
    row reached has a null doc_id. Null and empty texts have fingerprint zero,
    linked like any other. Whole texts of any length count, in time and memory
    linear in them. Repeated rows stay repeated; an empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    rows = stage(fingerprints(docs, words))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.join(_classes(rows, bits), "fingerprint").select("doc_id", hexed, "component_id")


#: Up to this many keys of documents are sent to all tasks; beyond it they are shuffled.
SENT = 1 << 18


def keep_first(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of the staged ``roots(doc_id, h, root)``, h the xxhash64 of the text: the smallest doc_id (null last), then h."""
    ident, key, none = free_name(docs, "__ident", "__key", "__none")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumns({none: F.col("doc_id").isNull(), ident: F.coalesce("doc_id", F.lit(0)), key: F.xxhash64(text)})
    keyed = roots.select(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h").alias("r"), "root")
    first = stage(keyed.groupBy("root").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")))
    many = first.filter("n > 1")
    # the other rows of roots with several, and rows that stand more than once: these alone have to be looked for
    rest = stage(keyed.join(many, "root").groupBy("r").agg(F.max(F.col("r") != F.col("first")).alias("goes"), F.count(F.lit(1)).alias("n")).filter("goes or n > 1"))
    gone = rest.select(F.col("r.none").alias(none), F.col("r.id").alias(ident), F.col("r.h").alias(key), "goes")
    keys = [none, ident, key]
    few = gone.count() <= SENT
    sent = F.broadcast(gone) if few else gone
    once = marked.join(sent.select(*keys), keys, "left_anti")
    twice = sent.filter("not goes").select(*keys)
    if twice.isEmpty():
        return once.select(*docs.columns)
    return once.unionByName(marked.join(twice, keys, "left_semi").dropDuplicates(keys)).select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, words: int = 5, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then of the smallest hash of its text.

    Of equal rows one stays. Null and empty texts are near-duplicates of each other.
    Whole texts of any length count; an empty table stays empty; other columns,
    whatever their names, are kept as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = fingerprints(docs.select(F.struct("doc_id", F.xxhash64(text).alias("h")).alias("doc_id"), "text"), words)
    rows = stage(prints.select("doc_id.doc_id", "doc_id.h", "fingerprint"))
    return keep_first(docs, stage(rows.join(_classes(rows, bits), "fingerprint").select("doc_id", "h", "root")))
