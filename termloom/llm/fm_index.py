"""A compressed full-text index over words: Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank: one running count for every 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block = i >> 6
        low = self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class Wavelet:
    """Rank of any symbol in a sequence, by a bit vector for every binary digit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.digits = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for d in range(self.digits - 1, -1, -1):
            bit = (symbols >> d & 1).astype(bool)
            self.levels.append((Bits(bit), int((~bit).sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = self._walk(np.arange(size), np.zeros(size, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, (bits, zeros) in zip(range(self.digits - 1, -1, -1), self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> d & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self.start[symbol]


class FmIndex:
    """Index of a text of numbers >= 1, with 0 between its passages, for patterns of up to ``depth`` numbers.

    Suffixes are sorted by at least their first ``depth`` numbers, which is all
    that backward search of such patterns looks at.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int):
        n = len(text)
        rank, seen = text.astype(np.int64), 1
        while seen < depth:
            after = np.zeros(n, dtype=np.int64)
            after[:-seen] = rank[seen:] + 1 if seen < n else 0
            _, rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            seen *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.transform = Wavelet(text[self.suffixes - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))[:-1]])
        padded = np.concatenate([text, np.zeros(depth, dtype=text.dtype)])
        same = np.ones(n - 1, dtype=bool)
        self.shorter: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(depth):  # rows that share their first depth - 1, then depth numbers
            if k == depth - 1:
                self.shorter = self._groups(same)
            a = padded[self.suffixes[:-1] + k]
            same &= a == padded[self.suffixes[1:] + k]
        self.full = self._groups(same)

    @staticmethod
    def _groups(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and one past the last row of its group."""
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        ends = np.concatenate([starts[1:], [len(same) + 1]])
        return np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that start with ``symbol`` and go on as those of the given intervals."""
        at = self.before[symbol]
        return at + self.transform.rank(symbol, low), at + self.transform.rank(symbol, high)


def window_matches(passages: list[list[int]], size: int, depth: int):
    """Matching statistics, up to ``depth``, of the passages against the index of them all.

    Yields (passage, offset, row) arrays for every place where a whole window of
    ``depth`` numbers is matched, ``row`` being the first index row of its
    interval; and the index itself, first, as (index, starts of the passages).
    Passages are read backwards side by side; when a match is ``depth`` long it
    is reported and cut to ``depth - 1`` before it is extended again.
    """
    length = np.array([len(p) for p in passages])
    starts = np.concatenate([[1], 1 + np.cumsum(length + 1)[:-1]])
    text = np.zeros(int((length + 1).sum()) + 1, dtype=np.int64)
    flat = np.concatenate([np.asarray(p, dtype=np.int64) for p in passages])
    text[np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(flat))] = flat
    index = FmIndex(text, size, depth)
    yield index, starts
    low, high = np.zeros(len(passages), dtype=np.int64), np.full(len(passages), len(text), dtype=np.int64)
    lane, matched = np.arange(len(passages)), 0
    for step in range(1, int(length.max()) + 1):
        on = length[lane] >= step
        lane, low, high = lane[on], low[on], high[on]
        place = length[lane] - step
        low, high = index.extend(text[starts[lane] + place], low, high)
        matched += 1
        if matched == depth:
            yield lane, place, low
            low, high = index.shorter[0][low], index.shorter[1][low]
            matched -= 1
