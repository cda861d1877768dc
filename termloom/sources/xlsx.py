"""Spreadsheets with the standard library: streaming reader and writer of .xlsx, and a data source.

``spark.read.format("sheet").load(path)`` makes a partition of each file, so a
folder of spreadsheets is read by as many tasks.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from termloom.sources.layout import SCAN_ROWS, column_names, header_row

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Fixed values of the format.
MAX_ROWS, MAX_CELL, MAX_NAME = 1_048_576, 32_767, 31
#: Fields that every row of the data source has besides the columns.
FILE, ROW = "__file", "__row"


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _place(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


class Workbook:
    """Reads one .xlsx row by row; cells are texts as they are stored, or None."""

    def __init__(self, path):
        self.zip = zipfile.ZipFile(path)
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        rels = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target", "") for r in rels}
        self.parts: dict[str, str] = {}
        for s in book.iter(f"{NS}sheet"):
            t = target[s.get(REL)]
            self.parts[s.get("name", "")] = t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self._shared: list[str] | None = None

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.zip.close()

    def sheets(self) -> list[str]:
        return list(self.parts)

    def _strings(self) -> list[str]:
        if self._shared is None:
            self._shared = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, el in ElementTree.iterparse(f):
                        if el.tag == f"{NS}si":
                            self._shared.append("".join(t.text or "" for t in el.iter(f"{NS}t")))
                            el.clear()
        return self._shared

    def rows(self, sheet: str, most: int | None = None) -> Iterator[list[str | None]]:
        done = 0
        with self.zip.open(self.parts[sheet]) as f:
            for _, el in ElementTree.iterparse(f):
                if el.tag != f"{NS}row":
                    continue
                at = int(el.get("r") or done + 1)
                while done + 1 < at:  # rows that are not stored are blank
                    done += 1
                    yield []
                    if most is not None and done >= most:
                        return
                out: list[str | None] = []
                for c in el.iter(f"{NS}c"):
                    i = _place(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (i - len(out))
                    out.append(self._cell(c))
                el.clear()
                done += 1
                yield out
                if most is not None and done >= most:
                    return

    def _cell(self, c) -> str | None:
        kind = c.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{NS}t"))
        v = c.find(f"{NS}v")
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self._strings()[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        return v.text

    def layout(self) -> tuple[str, int, float]:
        """The sheet most like a table, its header row and the confidence."""
        best = ("", 0, -1.0, -1)
        for name in self.sheets():
            rows = list(self.rows(name, SCAN_ROWS + 1))
            i, sure = header_row(rows)
            width = sum(1 for c in (rows[i] if rows else []) if c not in (None, ""))
            if (sure, width) > best[2:]:
                best = (name, i, sure, width)
        return best[:3]

    def header(self) -> list[str]:
        name, at, _ = self.layout()
        rows = list(self.rows(name, at + 1)) if name else []
        return column_names(rows[at]) if len(rows) > at else []

    def table(self) -> Iterator[tuple[int, list[str | None]]]:
        """(row number of the report, cells) of the data rows, padded or cut to the header."""
        name, at, _ = self.layout()
        width = len(self.header())
        for i, row in enumerate(self.rows(name)):
            if i > at:
                yield i - at + 1, (row + [None] * width)[:width]


def _cell_xml(ref: str, value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>' if abs(value) != float("inf") else ""
    text = value.isoformat() if isinstance(value, (date, datetime)) else str(value)
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "", text[:MAX_CELL])
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterable[Iterable[object]]]]) -> None:
    """Write sheets row by row to a file beside ``path``, then put it in place; no more rows than a sheet holds."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(suffix=".xlsx", dir=folder)
    os.close(fd)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names: list[str] = []
    for name in sheets:
        short, k = name[:MAX_NAME], 1
        while short in names:
            k += 1
            short = f"{name[: MAX_NAME - 3]}~{k}"
        names.append(short)
    try:
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            n = range(1, len(sheets) + 1)
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n)
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            quoted = [escape(x, {'"': "&quot;"}) for x in names]
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{q}" sheetId="{i}" r:id="rId{i}"/>' for i, q in zip(n, quoted)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
            for i, (columns, rows) in zip(n, sheets.values()):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                    f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                    for r, row in enumerate(_limited(columns, rows), 1):
                        cells = "".join(_cell_xml(f"{_letters(k)}{r}", v) for k, v in enumerate(row))
                        f.write(f'<row r="{r}">{cells}</row>'.encode())
                    f.write(b"</sheetData></worksheet>")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def _limited(columns: list[str], rows: Iterable[Iterable[object]]) -> Iterator[Iterable[object]]:
    yield columns
    for i, row in enumerate(rows, 2):
        if i > MAX_ROWS:
            return
        yield row


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.names = paths, schema.fieldNames()

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        with Workbook(path) as book:
            at = {c: i for i, c in enumerate(book.header())}
            for row, cells in book.table():
                own = {FILE: path, ROW: row}
                yield tuple(own[n] if n in own else cells[at[n]] if n in at else None for n in self.names)


class SheetSource(DataSource):
    """All .xlsx files of a path, or of the JSON list in the option ``paths``, as texts, with __file and __row; the schema is the union of their headers."""

    @classmethod
    def name(cls):
        return "sheet"

    def _paths(self) -> list[str]:
        from termloom.sources.files import data_files

        if "paths" in self.options:
            return json.loads(self.options["paths"])
        path = self.options["path"]
        return [path] if os.path.isfile(path) else [f for f in data_files([path])[0] if f.lower().endswith(".xlsx")]

    def schema(self):
        columns: dict[str, None] = {}
        for p in self._paths():
            with Workbook(p) as book:
                columns.update(dict.fromkeys(book.header()))
        return ", ".join([*[f"`{c.replace('`', '``')}` string" for c in columns], f"{FILE} string", f"{ROW} long"])

    def reader(self, schema):
        return _Reader(self._paths(), schema)
