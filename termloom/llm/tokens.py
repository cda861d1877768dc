"""Exact token counts of a byte-level BPE vocabulary at every prefix of a text.

A text is split into pieces as the vocabulary's pre-tokenizer does; merges never
cross a piece.  Inside a piece the last token of every prefix is found by dynamic
programming: the tokens of a prefix ``p`` are those of a shorter prefix followed
by one token ``t``, and they are the real encoding exactly if ``t`` may follow the
shorter prefix's last token, i.e. if merging the two tokens' bytes gives back the
two tokens.  The counts at all prefixes of a piece are kept.  The count of a
document prefix is the count at the last piece end before it plus the entry of the
piece it cuts, so truncation and budget questions are looked up, not encoded.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from termloom.llm._common import chunks

#: Splits a text into pieces. Fixed value of the public vocabulary.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes are the same in every Unicode version and regex engine; others go by the library's splitter.
PLAIN = r"[^\x00-\x1B\x20-ɏ‐-‧‰-⁞€™]"
#: Entries of a table in a worker's memory, and bytes of a piece whose prefix counts are kept between documents.
KEPT = 250_000
KEPT_BYTES = 64
#: Pieces that a cut inside splits another way: contractions, whose mark is then a piece of its own.
CONTRACTIONS = ("'re", "'ve", "'ll", "'s", "'t", "'m", "'d")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept(dict):
    """A bounded table that makes missing entries; the older half goes when it is full."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Token counts of texts and of their prefixes for one vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: "".join(chr(letters[c]) for c in token)  # noqa: E731  a byte a character
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        special = set(self.specials)
        self.tokens = ahocorasick.Automaton()
        for t in spec["model"]["vocab"]:
            if t not in special:
                self.tokens.add_word(raw(t), (raw(t), len(raw(t))))
        self.tokens.make_automaton()
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks: dict[tuple[str, str], int] = {}
        self.halves: dict[str, tuple[str, str, int]] = {}
        for i, (x, y) in enumerate(merges):
            x, y = raw(x), raw(y)
            self.ranks[x, y] = i
            self.halves.setdefault(x + y, (x, y, i))
        self.split = regex.compile(PIECE).findall
        self.odd = regex.compile(PLAIN).search
        self.tight = regex.compile(r"^ | $|\s \S| \s").search
        marks = "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))
        self.marks = regex.compile(marks) if marks else None
        self.follows = Kept(self._may_follow)
        self.right = Kept(lambda t: self._spine(t, 1))
        self.left = Kept(lambda t: self._spine(t, 0))
        self.tables = Kept(self.table)
        self.piece = Kept(lambda p: self.prefixes(p)[-1])
        self.spaced = Kept(self._spaced)
        self.library = None

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts that stand at one end of a token while it is merged, each with the rank that ends it."""
        out, ends = [], 1 << 60
        while True:
            out.append((token, ends))
            if token not in self.halves:
                return out
            ends = self.halves[token][2]
            token = self.halves[token][side]

    def _may_follow(self, pair: tuple[str, str]) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that complete them.

        Equal merges go from left to right: one that completes the left token
        wins over the crossing one, one that completes the right token loses.
        """
        rank, right = self.ranks.get, self.left[pair[1]]
        for x, x_ends in self.right[pair[0]]:
            for y, y_ends in right:
                r = rank((x, y))
                if r is not None and r < x_ends and r <= y_ends:
                    return False
        return True

    def table(self, piece: str) -> list[int]:
        """Counts at every byte prefix of a piece, from 0. An automaton gives the tokens that end at each byte, the longest first."""
        data = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1")
        follows = self.follows
        last: list[str | None] = [None] * (len(data) + 1)
        count = [0] * (len(data) + 1)
        for at, (token, size) in self.tokens.iter(data):
            at += 1
            if last[at] is None:
                start = at - size
                if not start or follows[last[start], token]:
                    last[at], count[at] = token, count[start] + 1
        return count

    def prefixes(self, piece: str) -> list[int]:
        """The table of a piece, from the kept ones if it is short."""
        return self.tables[piece] if len(piece) <= KEPT_BYTES else self.table(piece)

    def _spaced(self, word: str) -> int:
        """Tokens of a space and a word; letters alone are one piece with it."""
        if word.isalpha() and word.isascii():
            return self.prefixes(" " + word)[-1]
        return sum(map(self.piece.__getitem__, self.split(" " + word)))

    def pieces(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.split(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        return self.marks.split(text) if self.marks else [text]

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        Where single spaces stand between characters that are not blank, a space
        and what follows it up to the next one are pieces of their own, so they
        can be looked up together.
        """
        if self.odd(text) is None and self.tight(text) is None:
            first, *rest = text.split(" ")
            return sum(map(self.piece.__getitem__, self.split(first))) + sum(map(self.spaced.__getitem__, rest))
        return sum(map(self.piece.__getitem__, self.pieces(text)))

    def count(self, text: str) -> int:
        """Tokens of the text; a special token's string counts as that token."""
        parts = self.segments(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)

    def prefix_table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)

    def count_at(self, text: str, end: int) -> int:
        """Tokens of ``text[:end]`` as a text of its own."""
        return PrefixTable(self, text).at(end)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix that ends at a piece, or inside the next one, with at most ``budget`` tokens."""
        return text[: PrefixTable(self, text).cut(budget)]


class PrefixTable:
    """The token counts of a text at all its prefixes; every question after the first about a piece is a lookup."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.pieces: list[str] = []
        marks = counter.marks.findall(text) if counter.marks else []
        for i, part in enumerate(counter.segments(text)):
            self.pieces += [marks[i - 1]] if i else []
            self.pieces += counter.pieces(part) if part else []
        self.specials = set(counter.specials)
        self.own: dict[tuple[int, int], list[int]] = {}
        self.run = (0, 0)
        self.odd = counter.odd(text) is not None
        self.ends = list(accumulate(map(len, self.pieces)))
        self.counts = list(accumulate(1 if p in self.specials else counter.piece[p] for p in self.pieces))

    def _inside(self, start: int, piece: str) -> list[int]:
        """Counts at every character of the piece that begins at ``start``."""
        found = self.own.get((start, len(piece)))
        if found is None:
            table = self.counter.prefixes(piece)
            sizes = accumulate((len(c.encode("utf-8", "replace")) for c in piece), initial=0)
            found = self.own[start, len(piece)] = table if piece.isascii() else [table[i] for i in sizes]
        return found

    def _before(self, k: int) -> tuple[int, int]:
        """Where piece ``k`` begins, and the count up to there."""
        return (self.ends[k - 1], self.counts[k - 1]) if k > 0 else (0, 0)

    def _blanks(self, end: int) -> tuple[int, int]:
        """The run of blanks around the character before ``end``."""
        a, b = self.run
        if not a < end <= b:
            a = b = end - 1
            while a and self.text[a - 1].isspace():
                a -= 1
            while b < len(self.text) and self.text[b].isspace():
                b += 1
            self.run = a, b
        return a, b

    def at(self, end: int) -> int:
        """Tokens of ``text[:end]`` as a text of its own."""
        if end <= 0 or not self.text:
            return 0
        if end >= len(self.text):
            return self.counts[-1]
        k = bisect.bisect_left(self.ends, end)
        piece = self.pieces[k]
        start, count = self._before(k)
        cut = end < self.ends[k]
        if cut and piece in self.specials:  # a part of a special string is a text like any other
            start, count = self._before(k - 1) if k and self.pieces[k - 1] not in self.specials else (start, count)
            return count + self.counter.plain(self.text[start:end])
        if piece not in self.specials and self.text[end - 1].isspace():  # blanks at the end are one piece
            a, b = self._blanks(end)
            first = bisect.bisect_right(self.ends, a)  # the piece with the first blank
            start, count = self._before(first)
            if self.odd or start < a:
                return count + self.counter.plain(self.text[start:end])
            return count + self._inside(a, self.text[a:b])[end - a]
        if cut and piece in CONTRACTIONS:
            return count + self.counter.plain(piece[: end - start])
        return count + self._inside(start, piece)[end - start] if cut else self.counts[k]

    def cut(self, budget: int) -> int:
        """The end of the longest prefix that ends at a piece, or inside the next one, with at most ``budget`` tokens."""
        k = bisect.bisect_right(self.counts, budget)
        end = self.ends[k - 1] if k else 0
        if k < len(self.ends):
            end = next((e for e in range(self.ends[k] - 1, end, -1) if self.at(e) <= budget), end)
        return end


def _counter(path: str) -> PrefixCounter:
    found = _COUNTERS.get(path)
    if found is None:
        found = _COUNTERS[path] = PrefixCounter(path)
    return found


_COUNTERS: dict[str, PrefixCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; null text is empty, with no bytes and no tokens.

    ``path`` names the vocabulary file on every worker. Whole texts of any length
    are counted, in time linear in them. Repeated rows stay repeated; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch, texts in chunks(batches, "text"):
            n = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def truncate_to_budget(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix of the text with at most ``budget`` tokens; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch, texts in chunks(batches, "text"):
            none = batch.column(1).is_null().to_pylist()
            out = [None if gone else counter.truncate(t.decode("utf-8", "replace"), budget) for t, gone in zip(texts, none)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
