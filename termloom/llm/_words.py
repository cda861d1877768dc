"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bytes outside the six blanks.
UNBLANK = np.ones(256, dtype=bool)
UNBLANK[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, ``n`` of each at least; they are kept, so they grow by an eighth only."""
    have = len(_powers[0])
    if have < n:
        size = max(n, have + have // 8)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of ``texts``: bytes ``data[starts[i]:ends[i]]``; text k has words ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, texts: list[bytes], table: np.ndarray, lower: bool = False):
        raw = b" " + b" ".join(texts) + b" "
        self.raw = raw.lower() if lower else raw
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        inside = table[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.first = np.searchsorted(self.starts, self.begins)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (or of the same places of ``data``)."""
        data = self.data if data is None else data
        up, down = _power_tables(len(data) + 1)
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
        h = (sums[self.ends - 1] - sums[self.starts - 1]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def of_text(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
