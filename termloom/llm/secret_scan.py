"""Secret scans: fixed patterns, and guess costs of values in a credential context.

The guess cost of a value is the least cost of cutting it into parts that an
attacker would try in turn: dictionary words (with capitals, swapped letters or
backwards), dates, repeats, keyboard walks, alphabet or digit runs, and brute
force for what is left.  A dynamic program over the value's ends finds the
cheapest of all cuttings; costs are base-10 logarithms of guesses and add up.
Every value in a credential context is costed, those in base spans too, and is
reported if its cost reaches the threshold.

The dictionary is common passwords and the most frequent words of the corpus,
counted over all documents outside credential contexts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm._common import chunks
from termloom.llm._words import Words

# Fixed values of the contract: the base kinds, in their order.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
ASSIGN_LEAST = 6

#: Names that announce a credential; wider than the base pattern.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|credentials?|auth(?:[_-]?(?:key|token))?|(?:access|api|private|client|session|encryption)[_-]?(?:key|token|secret)|apikey|token|bearer|login)"""
    r"""(?:["']?\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|(?<=bearer)\x20+)(?:"([^"\s]{6,})|'([^'\s]{6,})|([^\s"'<>(){}\[\],;]{6,}))""",
    re.ASCII | re.IGNORECASE,
)
#: A text without any of these, in lower case, has no value in a credential context.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key", b"bearer", b"login")

# Passwords that guessers try first, best first.
COMMON = (
    "password", "admin", "login", "welcome", "secret", "dragon", "monkey", "letmein", "master", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "hello", "freedom", "whatever", "charlie", "trust", "love", "money", "root",
    "user", "test", "guest", "demo", "sample", "example", "changeme", "default", "qwerty", "summer", "winter", "spring", "autumn",
)
#: Corpus words a dictionary holds, the most frequent first, and their letters.
DICTIONARY = 1 << 16
SHORTEST, LONGEST = 3, 24
#: Letters often swapped for others.
SWAPS = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {(a, b) for up, down in zip(ROWS, ROWS[1:]) for i, a in enumerate(up) for b in down[max(0, i - 2) : i + 1]}
NEXT |= {(b, a) for a, b in NEXT}
DATES = tuple(
    re.compile(f"(?=({p}))")
    for p in (
        r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])",
        r"(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d",
        r"(?:19|20)\d\d",
    )
)
YEARS = 120
LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

#: log10 of the guesses from which a value in a credential context counts as a secret.
THRESHOLD = 8.0
#: Every further part doubles the ways to combine; a length is priced by its binary digits.
TWICE = math.log10(2)
#: A walk costs its start and half a choice among its keys' neighbours a step; a run its start and its length.
WALK_START, WALK_STEP, RUN_START = math.log10(47), math.log10(2.3) / 2, math.log10(72)
WALK_LEAST, RUN_LEAST, WIDEST = 4, 3, 4


def _alphabet(part: str) -> int:
    sizes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    n = sum(size for test, size in sizes if any(test(c) for c in part))
    return (n + 33 if any(not c.isalnum() for c in part) else n) or 33


def date_parts(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the dates and years in ``value``, overlapping ones too."""
    out = []
    for pattern in DATES:
        for m in pattern.finditer(value):
            size = len(m[1])
            out.append((m.start(), m.start() + size, math.log10(365 * YEARS if size > 4 else YEARS)))
    return out


class _Least:
    """Minima of any stretch of a growing array, from those of stretches of 1, 2, 4, ... that end at each place."""

    def __init__(self):
        self.levels = [array("d")]

    def append(self, x: float) -> None:
        at = len(self.levels[0])
        self.levels[0].append(x)
        for q in range(1, len(self.levels)):
            low = self.levels[q - 1]
            low_at = at - (1 << (q - 1))
            self.levels[q].append(min(low[at], low[low_at]) if low_at >= 0 else low[at])

    def of(self, a: int, b: int) -> float:
        """The minimum from place ``a`` to ``b``, both included."""
        q = (b - a + 1).bit_length() - 1
        while q >= len(self.levels):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(array("d", (min(low[i], low[i - step]) if i >= step else low[i] for i in range(len(low)))))
        return min(self.levels[q][b], self.levels[q][a + (1 << q) - 1])


class Guesser:
    """Guess costs by a dictionary of ``words``, best first, beside the common passwords."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for source in (COMMON, words):
            for i, w in enumerate(source, 1):
                self.rank[w] = min(i, self.rank.get(w, i))
        self.longest = max(map(len, self.rank))

    def word_cost(self, part: str) -> float | None:
        """The cost of a part that is a dictionary word, or one with swapped letters or backwards."""
        low = part.translate(LETTERS)
        found = [(self.rank.get(form), more) for form, more in ((low, 0.0), (low.translate(SWAPS), 0.6), (low[::-1], 0.3))]
        found = [math.log10(r + 1) + more for r, more in found if r]
        if not found:
            return None
        return min(found) + (0.0 if part == low else 0.3 if part[1:] == low[1:] or part.isupper() else 0.2 * len(part))

    def cost(self, value: str, enough: float = math.inf) -> float:
        """log10 of the guesses of the cheapest cutting of ``value``; 0 for the empty one.

        Once every way on costs ``enough`` the rest is not looked at and ``enough``
        is returned. All starts and ends of walks, runs and repeats are offered:
        their prices are linear in the length, or equal for all lengths of as
        many binary digits, so a place takes time in the logarithm of the run.
        """
        n = len(value)
        if not n:
            return 0.0
        brute = math.log10(_alphabet(value))
        low = value.translate(LETTERS)
        swapped = low.translate(SWAPS)
        dates: dict[int, list[tuple[int, float]]] = {}
        for i, j, price in date_parts(value):
            dates.setdefault(j, []).append((i, price))
        best = array("d", [0.0])
        start = _Least()  # the cost up to each place and of beginning a part there
        start.append(0.0)
        # where the walk, the rising and falling run and the repeats of each width that end at j begin
        walk, walk_best, rise, fall = 0, math.inf, 0, 0
        repeats = [0] * (WIDEST + 1)
        for j in range(1, n + 1):
            here = best[j - 1] + brute
            if j > 1:
                a, b = low[j - 2], low[j - 1]
                step = ord(b) - ord(a) if b.isalnum() else 0
                walk, walk_best = (walk, walk_best) if (a, b) in NEXT else (j - 1, math.inf)
                rise = rise if step == 1 else j - 1
                fall = fall if step == -1 else j - 1
            for size in range(SHORTEST, min(self.longest, j) + 1):
                part = low[j - size : j]
                if part in self.rank or swapped[j - size : j] in self.rank or part[::-1] in self.rank:
                    price = self.word_cost(value[j - size : j])
                    if price is not None:
                        here = min(here, start.levels[0][j - size] + price)
            for i, price in dates.get(j, ()):
                here = min(here, start.levels[0][i] + price)
            if j - walk >= WALK_LEAST:
                i = j - WALK_LEAST
                walk_best = min(walk_best, start.levels[0][i] - i * WALK_STEP)
                here = min(here, walk_best + WALK_START + (j - 1) * WALK_STEP)
            runs = [(rise, RUN_LEAST, RUN_START), (fall, RUN_LEAST, RUN_START)]
            for w in range(1, WIDEST + 1):
                if j > w and value[j - 1] != value[j - 1 - w]:
                    repeats[w] = j - w
                runs.append((repeats[w], max(RUN_LEAST, 2 * w), w * brute))
            for begin, least, price in runs:
                longest = j - begin
                if longest >= least:
                    for digits in range(least.bit_length(), longest.bit_length() + 1):
                        most = min(longest, (1 << digits) - 1)
                        here = min(here, start.of(j - most, j - max(least, 1 << (digits - 1))) + price + digits * TWICE)
            best.append(here)
            start.append(here + TWICE)
            if j < 64 or j % 64 == 0:
                # no part that goes over this place begins before ``first``
                first = max(0, min(walk, rise, fall, min(repeats[1:]), j - max(self.longest, 10)))
                if j - first <= 4096 and min(best[first:]) >= enough:
                    return enough
        return best[n]


def corpus_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The ``most`` most frequent words of letters in all texts, ties in their own order; values in a credential context are not counted.

    Words of SHORTEST to LONGEST ASCII letters, lower-cased. The driver and every
    worker hold ``most`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(256, dtype=bool)
        letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        for _, texts in chunks(batches, "text"):
            w = Words([CONTEXT_BYTES.sub(b" ", t) if hinted(t) else t for t in texts], letters, lower=True)
            size = w.ends - w.starts
            some = np.flatnonzero((size >= SHORTEST) & (size <= LONGEST))
            if not len(some):
                continue
            _, first, n = np.unique(w.hashes()[some], return_index=True, return_counts=True)
            at = some[first]
            words = [w.raw[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    counts = docs.select(docs["text"].cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).toLocalIterator()]


def scan(text: str, threshold: float = THRESHOLD, guesser: Guesser = Guesser()) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the base spans and of costly values, by start then kind.

    A value that several patterns find is one span of kind ``guess``.
    """
    low = text.lower()
    spans: list[tuple[int, int, int]] = []
    values: set[tuple[int, int]] = set()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                spans.append((m.start(), m.end(), 0))
                values.add(m.span(2))
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    at = 0
    while m := CONTEXT.search(text, at):
        values.add(next(m.span(k) for k in (1, 2, 3) if m.group(k) is not None))
        at = max(m.end(), m.start() + 1)
    cut = {(a, a + len(text[a:b].rstrip(".:!?…"))) for a, b in values}
    spans += [(a, b, 3) for a, b in cut if b - a >= ASSIGN_LEAST and guesser.cost(text[a:b], threshold) >= threshold]
    return sorted(spans)


CONTEXT_BYTES = re.compile(CONTEXT.pattern.encode(), re.IGNORECASE)
HEX_BYTES = re.compile(rb"[0-9a-f]{24}").search


def hinted(raw: bytes) -> bool:
    low = raw.lower()
    return any(h in low for h in HINTS)


def scan_bytes(raw: bytes, threshold: float = THRESHOLD, guesser: Guesser = Guesser()) -> list[tuple[int, int, int]]:
    if not hinted(raw) and b"AKIA" not in raw and HEX_BYTES(raw) is None:
        return []
    return scan(raw.decode("utf-8", "replace"), threshold, guesser)


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id with array<struct<kind, start, end>> of every row, in code points, ends exclusive.

    The corpus words are counted over all of ``docs`` first. Null or empty text
    has no spans; repeated rows stay repeated and have equal spans; spans that
    start together come in the order of KINDS, then by end; an empty table gives
    no rows; other columns, whatever their names, are not read. Whole texts are
    scanned: the time is linear in the length but for the logarithm of runs.
    """
    guesser = docs.sparkSession.sparkContext.broadcast(Guesser(corpus_words(docs, dictionary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, texts in chunks(batches, "text"):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan_bytes(t, threshold, guesser.value)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
