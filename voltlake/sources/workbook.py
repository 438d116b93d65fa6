"""Sheets of an .xlsx workbook as rows of text: a zip of XML parts, read with the standard
library. For registers of some megabytes; a larger workbook is refused."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

LIMIT = 256 << 20
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that are dates.
DATE_FORMATS = {*range(14, 18), 22}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _column(cell: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > LIMIT:
            raise ValueError(f"a workbook of over {LIMIT} bytes")
        relations = {r.get("Id"): r.get("Target") for r in self._parse("xl/_rels/workbook.xml.rels")}
        book = self._parse("xl/workbook.xml")
        path = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): path(relations[s.get(_REL)]) for s in book.iter() if _local(s) == "sheet"}
        self.strings = [self._text(e) for e in self._parse("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.zip.namelist() else []
        self.dates = self._date_styles() if "xl/styles.xml" in self.zip.namelist() else set()

    def _parse(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    @staticmethod
    def _text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter() if _local(t) == "t")

    def _date_styles(self) -> set[int]:
        """Numbers of the cell styles that show dates."""
        styles, own = self._parse("xl/styles.xml"), set(DATE_FORMATS)
        for f in styles.iter():
            if _local(f) == "numFmt" and re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower())):
                own.add(int(f.get("numFmtId")))
        cells = next((e for e in styles if _local(e) == "cellXfs"), [])
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in own}

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t"), next((e.text for e in cell if _local(e) == "v"), None)
        if kind == "inlineStr":
            return self._text(cell)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind is None and int(cell.get("s", 0)) in self.dates:
            return (datetime(1899, 12, 30) + timedelta(days=float(value))).strftime("%Y-%m-%d")
        return value

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        """Rows of a sheet by their numbers, rows that are left out as empty ones."""
        at = 0
        for row in self._parse(self.sheets[sheet]).iter():
            if _local(row) != "row":
                continue
            number = int(row.get("r", at + 1))
            for _ in range(number - at - 1):
                yield []
            at, out = number, []
            for cell in row:
                k = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (k + 1 - len(out))
                out[k] = self._value(cell)
            yield out
