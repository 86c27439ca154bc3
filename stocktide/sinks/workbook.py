"""Workbooks for people to read: sheets of a DataFrame each, written row by row on the driver. Tables for machines are written by Spark."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from stocktide.operators import extract, reconcile, report, sync
from stocktide.sources import files

SHEET_ROWS = 1 << 20  # what the format can hold
KINDS = "http://schemas.openxmlformats.org/package/2006"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
# Names of sheets.
UNIFIED, DETAIL, SAME, MANUAL, TODO, SUMMARY, RESULTS, BY_PRODUCT = "统一库存", "差异明细", "无差异", "需人工处理", "待处理商品清单", "汇总", "同步结果", "按商品汇总"
# Fixed values, too: the grounds of headers, rows and cells that change.
FILLS = {"head": "1F3864", "changed": "FFC7CE", "marked": "FF7C80", "same": "E2EFDA", "manual": "FFEB9C"}
STYLE = {kind: k for k, kind in enumerate(FILLS, 1)}


def letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(ref: str, value, style: int = 0) -> str:
    look = f' s="{style}"' if style else ""
    if value is None or value == "":
        return f'<c r="{ref}"{look}/>' if style else ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        clean = "".join(c for c in str(value) if c in "\t\n" or c >= " ")
        return f'<c r="{ref}"{look} t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'
    return f'<c r="{ref}"{look}><v>{value}</v></c>'


def _styles() -> str:
    """A cell style for each of FILLS, numbered from 1 in their order."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    looks = "".join(f'<xf numFmtId="0" fontId="{int(kind == 'head')}" fillId="{k}" borderId="0" xfId="0" applyFill="1" applyFont="1"/>' for k, kind in enumerate(FILLS, 2))
    return f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FILLS) + 1}"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{looks}</cellXfs></styleSheet>'


def write_book(path: str, sheets: list[tuple]) -> str:
    """sheets: (name, header, rows), and maybe a function that gives a row's values and the style of each. A sheet that gets more rows
    than the format holds is an error, never cut."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for k, (name, header, rows, *look) in enumerate(sheets, 1):
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
                n = 0
                for n, (row, styles) in enumerate(_chained(header, rows, *look), 1):
                    if n > SHEET_ROWS:
                        raise ValueError(f"sheet {name} has over {SHEET_ROWS} rows")
                    f.write(f'<row r="{n}">{"".join(_cell(f"{letters(c)}{n}", v, s) for c, (v, s) in enumerate(zip(row, styles), 1))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, *_) in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        links += f'<Relationship Id="looks" Type="{OFFICE}/relationships/styles" Target="styles.xml"/>'
        book.writestr("xl/styles.xml", _styles())
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{KINDS}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{KINDS}/relationships"><Relationship Id="rId1" Type="{OFFICE}/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        kinds += "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{KINDS}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    return path


def _chained(header, rows, look=None):
    """(values, styles) of the header and the rows."""
    yield header, [STYLE["head"]] * len(header)
    for row in rows:
        yield look(row) if look else (row, [0] * len(row))


def _marked(kind: str):
    """Display columns on the ground of their kind; quantities and statuses that change stand out."""

    def look(row) -> tuple[tuple, list[int]]:
        styles = [STYLE[kind]] * len(report.DIFF_HEADER)
        for flag, cells in (("mark_quantity", (8, 9, 10)), ("mark_status", (11, 12))):
            for c in cells if row[flag] else ():
                styles[c] = STYLE["marked"]
        return tuple(row)[: len(report.DIFF_HEADER)], styles

    return look


def _sheet(name: str, df: DataFrame, header: list[str] | None = None) -> tuple[str, list[str], object]:
    return name, list(header or df.columns), df.toLocalIterator()


def write_unified(rows: DataFrame, folder: str, only: list[str] | None = None) -> list[str]:
    """A workbook for each source; one of all only if no source was left out. rows: the unified columns and `ord`."""
    paths = []
    for source in sorted(r["source"] for r in rows.select("source").distinct().collect()):  # one row per configured source
        own = rows.where(rows["source"] == source).orderBy("ord").select(*extract.UNIFIED)
        paths.append(write_book(f"{folder}/{source}{files.UNIFIED_SUFFIX}", [_sheet(UNIFIED, own)]))
    if paths and not only:
        paths.append(write_book(f"{folder}/{files.COMBINED}", [_sheet(UNIFIED, rows.orderBy("ord").select(*extract.UNIFIED))]))
    return paths


def write_diff(diffs: DataFrame, products: DataFrame, path: str, meta: dict | None = None) -> str:
    """Changed, unchanged and manual rows, manual rows by product, and the summary."""
    shown = report.present(diffs)
    pick = lambda *kinds: shown.where(shown["status"].isin(*kinds)).orderBy("ord").select(*report.DIFF_HEADER, "mark_quantity", "mark_status").toLocalIterator()
    header = list(report.DIFF_HEADER)
    todo = report.todo(diffs, products).orderBy("ord").drop("ord")
    summary = [*[(k, str(v)) for k, v in (meta or {}).items()], *[(r["label"], r["figure"]) for r in report.summary_rows(diffs).orderBy("line").collect()]]
    return write_book(path, [
        (DETAIL, header, pick(reconcile.CHANGED), _marked("changed")), (SAME, header, pick(reconcile.SAME), _marked("same")), (MANUAL, header, pick(*reconcile.MANUAL), _marked("manual")), _sheet(TODO, todo, list(report.TODO_HEADER)), (SUMMARY, ["", ""], summary),
    ])


def write_sync_log(results: DataFrame, path: str, meta: dict | None = None) -> str:
    """Every write, writes by product, and the totals."""
    from stocktide.storage import stored

    results = stored(results, "sync-log")
    totals = sync.totals(results).first().asDict()
    log = sync.log_rows(results, extract.numbered).orderBy(sync.LOG_COLUMNS[0])
    return write_book(path, [_sheet(RESULTS, log), _sheet(BY_PRODUCT, sync.by_product(results)), (SUMMARY, ["", ""], [*(meta or {}).items(), *totals.items()])])
