"""Finding the header of a sheet, and making its names usable."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

# Rows looked at, and words that headers tend to hold.
SCAN_ROWS = 20
HINTS = ("公司", "企业", "股票", "证券", "代码", "编号", "日期", "时间", "年份", "year", "date", "code", "company", "文本", "内容", "正文", "回复", "问题", "标题", "摘要", "text", "content", "reply", "question", "body")
# Points for each unit of a row's features.
POINTS = {
    "filled cells": 3.0,
    "share of distinct cells": 4.0,
    "cells that are no numbers": 1.5,
    "cells with a hint": 15.0,
    "filled cells of the next row, its own at most": 0.5,
    "rows left of the first five": 0.75,
    "single cell": -12.0,
    "blank": -1000.0,
}
EMPTY = frozenset(("", "nan", "none", "nat"))


def _filled(row: Iterable[object]) -> list[str]:
    texts = ("" if v is None else str(v).strip() for v in row)
    return [t for t in texts if t.lower() not in EMPTY]


def row_features(rows: Sequence[Sequence[object]]) -> np.ndarray:
    """A row of features, in the order of POINTS, for each of the first rows; blank rows have no others."""
    cells = [_filled(r) for r in rows[: SCAN_ROWS + 1]]
    sizes = np.array([*map(len, cells), 0])
    out = np.zeros((min(len(rows), SCAN_ROWS), len(POINTS)))
    for i, own in enumerate(cells[: len(out)]):
        numbers = sum(t.replace(".", "", 1).isdigit() for t in own)
        hinted = sum(any(h in t.lower() for h in HINTS) for t in own)
        out[i] = [len(own), len(set(own)) / max(1, len(own)), len(own) - numbers, hinted, sizes[i : i + 2].min(), max(0, 5 - i) * bool(own), len(own) == 1, not own]
    return out


def header_row(rows: Sequence[Sequence[object]]) -> tuple[int, float]:
    """The row most like a header, the earlier of equals, and a confidence from 0 to 1."""
    if not rows:
        return 0, 0.0
    points = row_features(rows) @ np.array([*POINTS.values()])
    best = int(points.argmax())
    widest = max(map(len, rows))
    return best, round(float(np.clip(points[best] / max(20.0, 6.0 * widest + 15.0), 0.0, 1.0)), 3)


def column_names(header: Sequence[object]) -> list[str]:
    """Unique names: blank cells by their place, repeats numbered from .1 on."""
    out: list[str] = []
    last: dict[str, int] = {}
    for i, cell in enumerate(header):
        base = str(cell) if cell is not None and cell == cell and str(cell).strip() else f"Unnamed: {i}"
        k = last.get(base, 0)
        name = base if not k else f"{base}.{k}"
        while name in out:
            k += 1
            name = f"{base}.{k}"
        last[base] = k
        out.append(name)
    return out


def best_column(frequency: dict[str, int], patterns: Sequence[str]) -> str | None:
    """The most frequent column whose name holds the first pattern that any name holds."""
    for p in patterns:
        found = [c for c in frequency if p.lower() in c.lower()]
        if found:
            return max(found, key=lambda c: frequency[c])
    return None
