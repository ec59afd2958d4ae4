"""XLSX workbooks without any library for them: the archive is checked first, then one worksheet is read as a table.

A workbook is small by its limits, so the driver reads it. Formulas come as text and are never evaluated.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from math import isfinite
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tablepulse.config import ResourceLimits
from tablepulse.operators.frame import Table
from tablepulse.sources import errors as E
from tablepulse.sources.common import Ingestion, check_count, check_loaded, check_names, check_size, display_name, logged

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Fixed values of the format.
PLAIN_TYPE = b"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
MACRO_TYPE = b"application/vnd.ms-excel.sheet.macroenabled.main+xml"
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "xl/workbook.xml")
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
Cell = tuple[object, str]  # value and kind: s text, n number, b truth, d date, e error


def _unsafe(name: str) -> bool:
    plain = name.replace("\\", "/")
    return not name or "\x00" in name or plain.startswith("/") or re.match(r"[A-Za-z]:", plain) is not None or ".." in plain.split("/")


def check_archive(content: bytes, limits: ResourceLimits) -> None:
    """Refuses what is no plain workbook, or may not be unpacked safely."""
    check_size(len(content), limits.source_bytes)
    if not content:
        raise E.EmptySource("The source holds nothing.")
    if content.startswith(OLE):
        raise E.UnsupportedWorkbook("Old binary workbooks are not read.")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            members = archive.infolist()
            names = [m.filename for m in members]
            _limit("archive entries", len(members), limits.archive_entries)
            if len({posixpath.normpath(n.replace("\\", "/")).casefold() for n in names}) < len(names):
                raise E.ArchiveSafety("Two members of the archive have one path.")
            if any(map(_unsafe, names)):
                raise E.ArchiveSafety("A member's path leads out of the archive.")
            if any(m.flag_bits & 1 for m in members):
                raise E.ArchiveSafety("Encrypted members are not read.")
            _limit("uncompressed bytes", sum(m.file_size for m in members), limits.uncompressed_bytes)
            if any(m.file_size and (not m.compress_size or m.file_size / m.compress_size > limits.compression_ratio) for m in members):
                raise E.ArchiveSafety("A member is compressed beyond the limit.")
            if not set(REQUIRED) <= set(names):
                raise E.UnsupportedWorkbook("The archive is no workbook.")
            types = archive.read(REQUIRED[0]).lower()
            if MACRO_TYPE in types or any(n.lower().endswith("vbaproject.bin") for n in names):
                raise E.UnsupportedWorkbook("Workbooks with macros are not read.")
            if PLAIN_TYPE not in types:
                raise E.UnsupportedWorkbook("The archive is no workbook.")
            if archive.testzip() is not None:
                raise E.MalformedWorkbook("A member's checksum is wrong.")
    except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, zlib.error) as error:
        raise E.MalformedWorkbook("The source is no archive.") from error


def _limit(what: str, observed: int, most: int) -> None:
    if observed > most:
        raise E.WorkbookLimitExceeded(f"The workbook has {observed} {what}; the limit is {most}.", resource=what, observed=observed, limit=most)


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise E.MalformedWorkbook("A member declares entities.")
    return ElementTree.fromstring(raw)


@dataclass
class Sheet:
    title: str
    state: str
    path: str


class Workbook:
    def __init__(self, content: bytes) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        book = _xml(self.archive, "xl/workbook.xml")
        relations = {}
        if "xl/_rels/workbook.xml.rels" in self.archive.namelist():
            for r in _xml(self.archive, "xl/_rels/workbook.xml.rels"):
                target = r.attrib.get("Target", "")
                relations[r.attrib.get("Id")] = (target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target), r.attrib.get("Type", ""))
        self.old_epoch = any(_tag(e) == "workbookPr" and e.attrib.get("date1904") in ("1", "true") for e in book.iter())
        sheets = [e for e in book.iter() if _tag(e) == "sheet"]
        self.sheets = [Sheet(e.attrib.get("name", ""), e.attrib.get("state", "visible"), relations.get(e.attrib.get(RELATION), ("", ""))[0]) for e in sheets]
        self.strings = self._strings()
        self.date_styles = self._date_styles()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.archive.namelist():
            return []
        return ["".join(t.text or "" for part in si if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t") for si in _xml(self.archive, "xl/sharedStrings.xml") if _tag(si) == "si"]

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.archive.namelist():
            return set()
        root = _xml(self.archive, "xl/styles.xml")
        own = {}
        for e in root.iter():
            if _tag(e) == "numFmt":
                bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.attrib.get("formatCode", ""))
                own[int(e.attrib["numFmtId"])] = re.search(r"[dmyhs]", bare, re.IGNORECASE) is not None and "general" not in bare.lower()
        formats = next((e for e in root if _tag(e) == "cellXfs"), [])
        ids = [int(x.attrib.get("numFmtId", 0)) for x in formats]
        return {k for k, i in enumerate(ids) if own.get(i, i in DATE_FORMATS)}

    def _moment(self, serial: float) -> object:
        if 0 <= serial < 1:
            seconds = round(serial * 86_400)
            return time(seconds // 3600 % 24, seconds // 60 % 60, seconds % 60).isoformat()
        start = datetime(1904, 1, 1) if self.old_epoch else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
        return start + timedelta(milliseconds=round(serial * 86_400_000))

    def _cell(self, e: ElementTree.Element) -> Cell:
        kind, value, formula, inline = e.attrib.get("t", "n"), None, None, None
        for part in e:
            tag = _tag(part)
            if tag == "v":
                value = part.text
            elif tag == "f":
                formula = part.text or ""
            elif tag == "is":
                inline = "".join(t.text or "" for t in part.iter() if _tag(t) == "t")
        if formula is not None:
            return "=" + formula, "s"
        if kind == "inlineStr":
            return inline, "s"
        if value is None:
            return None, "n"
        if kind == "s":
            return self.strings[int(value)], "s"
        if kind in ("str", "e"):
            return value, "e" if kind == "e" else "s"
        if kind == "b":
            return value == "1", "b"
        if kind == "d":
            return datetime.fromisoformat(value), "d"
        number = float(value)
        if int(e.attrib.get("s", 0)) in self.date_styles and isfinite(number):
            moment = self._moment(number)
            return moment, "d" if isinstance(moment, datetime) else "s"
        return int(value) if re.fullmatch(r"[+-]?[0-9]+", value) else number, "n"

    def rows(self, sheet: Sheet) -> Iterator[list[Cell]]:
        """All rows from the first, blank ones too, as lists of cells."""
        root, at = _xml(self.archive, sheet.path), 0
        for row in (r for r in root.iter() if _tag(r) == "row"):
            number = int(row.attrib.get("r", at + 1))
            for _ in range(at + 1, number):
                yield []
            at, cells = number, []
            for c in (c for c in row if _tag(c) == "c"):
                letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                place = column_number(letters[0]) if letters else len(cells)
                cells += [(None, "n")] * (place - len(cells))
                cells.append(self._cell(c))
            yield cells

    def merges(self, sheet: Sheet) -> list[tuple[int, int]]:
        """First and last row of each merged range."""
        out = []
        for e in _xml(self.archive, sheet.path).iter():
            if _tag(e) == "mergeCell":
                m = re.fullmatch(r"\$?[A-Z]+\$?([0-9]+)(?::\$?[A-Z]+\$?([0-9]+))?", e.attrib.get("ref", ""))
                if not m:
                    raise E.MalformedWorkbook("A merged range is malformed.")
                out.append((int(m[1]), int(m[2] or m[1])))
        return out


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def select_sheet(book: Workbook, wanted: str | None, most_cells: int) -> Sheet:
    """The sheet of that exact name, hidden or not; else the only visible one with any value."""
    names = tuple(display_name(s.title, "worksheet") for s in book.sheets)
    if not book.sheets:
        raise E.NoUsableWorksheet("The workbook has no worksheets.")
    if wanted is not None:
        for s in book.sheets:
            if s.title == wanted:
                return s
        raise E.WorksheetNotFound("The workbook has no such worksheet.", worksheets=names)
    usable, looked = [], 0
    for s in book.sheets:
        if s.state != "visible":
            continue
        for row in book.rows(s):
            looked += max(1, len(row))
            _limit("cells looked at for a worksheet", looked, most_cells)
            if any(v is not None for v, _ in row):
                usable.append(s)
                break
    if not usable:
        raise E.NoUsableWorksheet("No visible worksheet holds a value.")
    if len(usable) > 1:
        raise E.WorksheetSelectionRequired("Several worksheets hold values; choose one.", worksheets=tuple(display_name(s.title, "worksheet") for s in usable))
    return usable[0]


def header_names(cells: list[Cell]) -> list[str]:
    """Text as it stands, truth values in capitals, numbers and dates as their text; typed doubles are refused too."""
    names: list[str | None] = []
    for v, kind in cells:
        if kind == "e" or v is None or (isinstance(v, str) and not v.strip()) or (isinstance(v, float) and not isfinite(v)):
            names.append(None)
        elif isinstance(v, bool):
            names.append(str(v).upper())
        else:
            names.append(v if isinstance(v, str) else v.isoformat() if isinstance(v, datetime) else repr(v))
    if None in names:
        raise E.InvalidColumnNames("Some column names are missing or blank.", positions=tuple(i for i, n in enumerate(names, 1) if n is None))
    keys = [(type(v), v) for v, _ in cells]
    if twice := tuple(dict.fromkeys(n for n, k in zip(names, keys, strict=True) if keys.count(k) > 1)):
        raise E.DuplicateColumns("Some column names stand more than once.", names=twice)
    return check_names(names)


def read_sheet(book: Workbook, sheet: Sheet, limits: ResourceLimits) -> tuple[list[str], list[list[object]], list[object]]:
    """(names, rows, original header): the first row with a value is the header; blank rows within the table stay, those after it go."""
    header: list[Cell] | None = None
    header_row, blank, scanned, width = 0, 0, 0, 0
    rows: list[list[object]] = []
    for number, cells in enumerate(book.rows(sheet), 1):
        scanned += max(1, len(cells))
        _limit("scanned cells", scanned, limits.workbook_cells)
        while cells and cells[-1][0] is None:
            cells = cells[:-1]
        check_count(None, len(cells), limits)
        if header is None:
            if cells:
                header, header_row, width = cells, number, len(cells)
            continue
        if not cells:
            blank += 1
            continue
        check_count(len(rows) + blank + 1, None, limits)
        rows += [[] for _ in range(blank)]
        blank = 0
        rows.append([v for v, _ in cells])
        width = max(width, len(cells))
    if header is None:
        raise E.EmptyWorksheet("The worksheet holds no values.")
    if not rows:
        raise E.NoDataRows("The worksheet has a header but no rows.")
    _limit("table cells", (len(rows) + 1) * width, limits.workbook_cells)
    if any(a <= header_row <= b for a, b in book.merges(sheet)):
        raise E.UnsupportedWorksheet("Merged cells reach into the header.")
    names = header_names(header + [(None, "n")] * (width - len(header)))
    return names, [r + [None] * (width - len(r)) for r in rows], [v for v, _ in header]


def column_type(values: list[object]) -> str:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return "double"
    if kinds <= {bool}:
        return "boolean"
    if kinds <= {int} and all(-(2**63) <= v < 2**63 for v in values if v is not None):
        return "bigint"
    if kinds <= {int, float}:
        return "double"
    return "timestamp_ntz" if kinds <= {datetime} else "string"


def _as(kind: str, v: object) -> object:
    if v is None or kind in ("boolean", "bigint", "timestamp_ntz"):
        return v
    if kind == "double":
        return float(v)
    return str(v).upper() if isinstance(v, bool) else v.isoformat() if isinstance(v, datetime) else str(v)


def ingest_xlsx(spark: SparkSession, content: bytes, name: str = "unnamed.xlsx", worksheet: str | None = None, limits: ResourceLimits | None = None) -> Ingestion:
    """Columns of one kind keep it; mixed ones become text."""
    limits, shown = limits or ResourceLimits(), display_name(name, "unnamed.xlsx")

    def load() -> Ingestion:
        check_archive(content, limits)
        try:
            book = Workbook(content)
            _limit("worksheets", len(book.sheets), limits.worksheets)
            sheet = select_sheet(book, worksheet, limits.workbook_cells)
            names, rows, original = read_sheet(book, sheet, limits)
        except (KeyError, IndexError, ValueError, OverflowError, ElementTree.ParseError) as error:
            raise E.MalformedWorkbook("The workbook is malformed.") from error
        kinds = [column_type([r[i] for r in rows]) for i in range(len(names))]
        typed = [tuple(_as(k, v) for k, v in zip(kinds, r, strict=True)) for r in rows]
        df = spark.createDataFrame(typed, ", ".join(f"_c{i} {k}" for i, k in enumerate(kinds)))
        facts = {"worksheet": sheet.title, "worksheets": len(book.sheets), "visible": sum(s.state == "visible" for s in book.sheets), "header": original}
        return Ingestion(Table(df, tuple(names)), check_loaded(df, len(rows), len(names)), "xlsx", shown, len(content), format=facts)

    return logged("xlsx", shown, len(content), load)


def read_xlsx(spark: SparkSession, path: str, worksheet: str | None = None, limits: ResourceLimits | None = None) -> Ingestion:
    """A workbook on any storage."""
    limits = limits or ResourceLimits()
    file = spark.read.format("binaryFile").load(path)
    check_size(file.select("length").first()[0], limits.source_bytes)
    return ingest_xlsx(spark, bytes(file.select(F.col("content")).first()[0]), path, worksheet, limits)
