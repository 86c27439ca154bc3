"""Workbooks as tables of cells and merged ranges, with types kept: a data source that reads each sheet in a task of its own.

`spark.read.format("xlsx_table")` takes a path (a file, a folder, or a pattern in the last part of either), and as options the `sheet`,
`columns` (letters, such as "B,C"), `first_row` and `last_row` to keep, and `table`: "cells" or "merges". Only the parts of a workbook
that a sheet needs are read, rows beyond the last are not parsed, and columns that are left out are not decoded.

A cell's kind is "n" for numbers, "b" for booleans ("True", "False"), "d" for numbers in a date's format (as date and time in ISO form) and
"s" for text. Files are opened through pyarrow, so tasks have to reach their store that way.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stocktide.functions.text import column_number

CELLS = "file string, sheet string, row int, col int, value string, kind string"
MERGES = "file string, sheet string, min_row int, max_row int, min_col int, max_col int"
# The namespaces of the format, its built-in date formats, and what a format of one's own has to hold to be a date's.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
QUOTED = re.compile(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|\*.', re.I)
DATE_LETTERS = re.compile(r"[dmyhs]", re.I)
PASSED = re.compile(r"\[(h+|m+|s+)\]", re.I)
PLACE = re.compile(r"([A-Z]+)([0-9]+)")


def place(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as B12."""
    letters, digits = PLACE.fullmatch(ref.replace("$", "")).groups()
    return int(digits), column_number(letters)


def open_store(path: str):
    """(file system, path there)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":" in path.split("/")[0] else posixpath.abspath(path))


def workbooks(path: str) -> list[str]:
    """The files that a path stands for, sorted."""
    from pyarrow.fs import FileSelector, FileType

    files, where = open_store(path)
    if files.get_file_info(where).type == FileType.File:
        return [where]
    folder, pattern = (where, "*.xlsx") if files.get_file_info(where).type == FileType.Directory else posixpath.split(where)
    found = files.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.type == FileType.File and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith((".", "~$")))


@dataclass
class SheetPart(InputPartition):
    """A sheet of a file: its name, and where its rows are in the file."""

    file: str
    sheet: str
    entry: str


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path) of the sheets, in their order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[sheet.get(f"{RELATED}id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)))
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == f"{MAIN}si":
                texts.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
                item.clear()
    return texts


def date_styles(book: zipfile.ZipFile) -> dict[int, bool]:
    """Numbers of the cell styles that show a date or a time, and whether that is a time which has passed."""
    if "xl/styles.xml" not in book.namelist():
        return {}
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): (x.get("formatCode") or "").split(";")[0] for x in styles.iter(f"{MAIN}numFmt")}
    dated = {k: bool(PASSED.search(code)) for k, code in own.items() if DATE_LETTERS.search(QUOTED.sub("", code))} | {k: k == 46 for k in DATE_FORMATS - own.keys()}
    cells = styles.find(f"{MAIN}cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in (cells if cells is not None else ())]
    return {k: dated[f] for k, f in enumerate(formats) if f in dated}


def date_text(serial: float, from_1904: bool, passed: bool = False) -> str:
    """A day number as date and time, below one day as a time alone, or as the time that has passed."""
    since = timedelta(milliseconds=round(serial * 86_400_000))
    if passed:
        return str(since)
    day = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if 0 < serial < 60 else datetime(1899, 12, 30)
    return str((day + since).time() if 0 <= serial < 1 else day + since)


def read_sheet(book: zipfile.ZipFile, entry: str, columns: set[int], first: int, last: int | None) -> Iterator[tuple]:
    """(row, col, value, kind) of the cells with a value (the stored one, where it is a formula) in a range of rows and columns."""
    shared, dated = _shared(book), date_styles(book)
    about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
    from_1904 = about is not None and about.get("date1904") in ("1", "true")
    with book.open(entry) as f:
        for event, item in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                if item.tag == f"{MAIN}row" and last is not None and int(item.get("r") or 0) > last:
                    return
                continue
            if item.tag == f"{MAIN}c":
                row, col = place(item.get("r"))
                if row < first or columns and col not in columns:
                    continue
                kind, value = item.get("t", "n"), item.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in item.iter(f"{MAIN}t"))
                elif value is None:
                    continue
                elif kind == "s":
                    value = shared[int(value)]
                elif kind == "b":
                    value = "True" if value == "1" else "False"
                elif kind == "n" and int(item.get("s") or 0) in dated:
                    kind, value = "d", date_text(float(value), from_1904, dated[int(item.get("s") or 0)])
                elif kind == "d":
                    value = value.replace("T", " ")
                yield row, col, value, kind if kind in ("n", "b", "d") else "s"
            elif item.tag == f"{MAIN}row":
                item.clear()


def read_ranges(book: zipfile.ZipFile, entry: str) -> Iterator[tuple]:
    """(min_row, max_row, min_col, max_col) of the merged ranges, which follow the rows."""
    with book.open(entry) as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == f"{MAIN}mergeCell":
                start, _, end = item.get("ref").partition(":")
                (r1, c1), (r2, c2) = place(start), place(end or start)
                yield r1, r2, c1, c2
            elif item.tag == f"{MAIN}row":
                item.clear()


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet, self.merges = options["path"], options.get("sheet"), options.get("table") == "merges"
        self.first_only = options.get("first_sheet") == "true"
        self.columns = {column_number(x) for x in (options.get("columns") or "").split(",") if x.strip()}
        self.first, self.last = int(options.get("first_row") or 1), options.get("last_row") and int(options["last_row"])

    def partitions(self) -> list[SheetPart]:
        parts, (files, _) = [], open_store(self.path)
        for file in workbooks(self.path):
            with files.open_input_file(file) as raw, zipfile.ZipFile(raw) as book:
                every = sheets(book)
                parts += [SheetPart(file, name, entry) for name, entry in (every[:1] if self.first_only else every) if self.sheet in (None, name)]
        return parts or [SheetPart("", "", "")]

    def read(self, part: SheetPart) -> Iterator[tuple]:
        if not part.file:
            return
        files, _ = open_store(self.path)
        with files.open_input_file(part.file) as raw, zipfile.ZipFile(raw) as book:
            found = read_ranges(book, part.entry) if self.merges else read_sheet(book, part.entry, self.columns, self.first, self.last)
            for item in found:
                yield posixpath.basename(part.file), part.sheet, *item


class XlsxTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_table"

    def schema(self) -> str:
        return MERGES if self.options.get("table") == "merges" else CELLS

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(XlsxTable)
    return spark.read.format("xlsx_table").options(**{k: v for k, v in options.items() if v is not None}).load(path)


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, columns: str | None = None, first_row: int | None = None, last_row: int | None = None, first_sheet: bool = False) -> DataFrame:
    """Cells of all workbooks under a path, of one sheet or of the first, and of some columns and rows."""
    return _read(spark, path, sheet=sheet, columns=columns, first_row=first_row, last_row=last_row, first_sheet=str(first_sheet).lower())


def read_merges(spark: SparkSession, path: str, sheet: str | None = None, first_sheet: bool = False) -> DataFrame:
    return _read(spark, path, table="merges", sheet=sheet, first_sheet=str(first_sheet).lower())
