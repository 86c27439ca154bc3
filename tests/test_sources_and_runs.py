"""Workbooks and the shop as data sources, versions of the catalogue, the unified table, and whole runs over a configuration."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from shop_server import ShopServer

from stocktide import runs
from stocktide.operators import extract, reconcile, sync
from stocktide.sinks import store, workbook
from stocktide.sources import files, xlsx
from stocktide.sources import shop as shop_source
from stocktide.sources.shop import Catalogue, Shop

STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="4"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd;@"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0;[Blue]-0"/><numFmt numFmtId="167" formatCode="[h]:mm"/></numFmts>
<cellXfs count="7"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="20"/><xf numFmtId="167"/></cellXfs></styleSheet>"""
SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" s="1"><v>45352</v></c><c r="B1" s="2"><v>45352.75</v></c><c r="C1" s="3"><v>3</v></c><c r="D1" s="4"><v>-4</v></c><c r="E1" s="5"><v>0.5</v></c><c r="F1" s="6"><v>1.5</v></c></row>
<row r="2"><c r="A2" t="b"><v>1</v></c><c r="B2" t="b"><v>0</v></c><c r="C2" t="str"><v>x y</v></c><c r="D2" t="e"><v>#N/A</v></c><c r="E2" s="1"/><c r="F2" t="s"><v>1</v></c></row>
<row r="3"><c r="A3"><v>7.5</v></c><c r="B3" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row><row r="9"><c r="A9"><v>9</v></c></row></sheetData>
<mergeCells count="2"><mergeCell ref="A1:B3"/><mergeCell ref="D4"/></mergeCells></worksheet>"""
BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{}<sheets><sheet name="one" sheetId="1" r:id="r1"/><sheet name="zwei" sheetId="2" r:id="r2"/></sheets></workbook>'


def book(path, about=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", BOOK.format(about))
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>no</t></si><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/b.xml", SHEET.replace("45352.75", "1"))
    return str(path)


def test_cells_keep_their_types(spark, tmp_path):
    path = book(tmp_path / "a.xlsx")
    got = {(r["sheet"], r["row"], r["col"]): (r["value"], r["kind"]) for r in xlsx.read_cells(spark, path).collect()}
    one = {k[1:]: v for k, v in got.items() if k[0] == "one"}
    assert one == {
        (1, 1): ("2024-03-01 00:00:00", "d"), (1, 2): ("2024-03-01 18:00:00", "d"), (1, 3): ("3", "n"), (1, 4): ("-4", "n"), (1, 5): ("12:00:00", "d"), (1, 6): ("1 day, 12:00:00", "d"),
        (2, 1): ("True", "b"), (2, 2): ("False", "b"), (2, 3): ("x y", "s"), (2, 4): ("#N/A", "s"), (2, 6): ("shared", "s"), (3, 1): ("7.5", "n"), (3, 2): ("ab", "s"), (9, 1): ("9", "n"),
    }
    assert got["zwei", 1, 2] == ("1900-01-01 00:00:00", "d")
    late = {(r["row"], r["col"]): r["value"] for r in xlsx.read_cells(spark, book(tmp_path / "mac.xlsx", '<workbookPr date1904="1"/>'), sheet="one", columns="A,C", first_row=1, last_row=2).collect()}
    assert late == {(1, 1): "2028-03-02 00:00:00", (1, 3): "3", (2, 1): "True", (2, 3): "x y"}
    assert {tuple(r)[1:] for r in xlsx.read_merges(spark, path).collect()} == {(s, *x) for s in ("one", "zwei") for x in ((1, 3, 1, 2), (4, 4, 4, 4))}


def test_sheets_are_read_in_tasks_of_their_own(spark, tmp_path):
    for k in range(3):
        book(tmp_path / f"w{k}.xlsx")
    (tmp_path / "~$w0.xlsx").write_text("open in an editor")
    cells = xlsx.read_cells(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() == 6 and cells.groupBy("file").count().count() == 3
    assert xlsx.read_cells(spark, f"{tmp_path}/w[12].xlsx", first_sheet=True).select("file", "sheet").distinct().count() == 2
    assert xlsx.read_cells(spark, f"{tmp_path}/none*.xlsx").count() == 0


def test_boolean_and_date_quantities(spark, tmp_path):
    path = book(tmp_path / "a.xlsx")
    none = spark.createDataFrame([], xlsx.MERGES)
    got = extract.table_rows(xlsx.read_cells(spark, path, sheet="one"), none, extract.Sheet("S", product="C", size="F", quantity="A")).collect()
    assert [(r["source_product"], r["size"], r["quantity"], r["availability"]) for r in got] == [("3", "1 DAY, 12:00:00", None, "instock"), ("x y", "SHARED", 1, "instock")]
    got = extract.table_rows(xlsx.read_cells(spark, path, sheet="one"), none, extract.Sheet("S", product="A", size="F", quantity="B")).collect()
    assert [(r["source_product"], r["quantity"], r["availability"]) for r in got] == [("2024-03-01 00:00:00", None, "instock"), ("True", 0, "outofstock")]


@pytest.fixture()
def server():
    products = [{"id": k, "sku": f"S{k}", "name": f"Name {k}", "type": "variable" if k % 2 else "simple"} for k in range(1, 24)]
    variations = {k: [{"id": 100 * k + v, "sku": "v", "attributes": [{"option": s}], "manage_stock": True, "stock_quantity": v, "stock_status": "instock"} for v, s in enumerate("SML")] for k in range(1, 24, 2)}
    made = ShopServer(products, variations)
    yield made
    made.close()


@pytest.mark.parametrize("totals", [True, False])
def test_every_page_is_asked_for_once(spark, server, totals):
    server.totals = totals
    found = shop_source.products(spark, Shop(server.url, per_page=2, pause=0.01), ranges=3)
    got = found.collect()
    assert sorted((r["ord"], r["id"]) for r in got) == [(k - 1, k) for k in range(1, 24)]
    pages = {path: n for path, n in server.asked.items() if "/products?" in path}
    assert len(pages) == 12 and set(pages.values()) == {1} and found.rdd.getNumPartitions() == (4 if totals else 2)


def test_a_reader_of_a_version_is_not_disturbed(spark, server, tmp_path):
    there, kept = Shop(server.url, per_page=5, pause=0.01), Catalogue(spark, f"{tmp_path}/catalogue")
    first = kept.pin(there)
    products, variations = kept.tables(first)
    server.products.append({"id": 99, "sku": "new", "name": "n", "type": "simple"})
    assert kept.pin(there) == first and kept.current(Shop("http://other")) is None
    second = kept.pin(there, refresh=True)
    assert second > first and kept.current(there) == second
    assert (products.count(), kept.tables(second)[0].count(), variations.count()) == (23, 24, 36)
    kept.forget()
    assert kept.current(there) is None and kept.tables(second)[0].count() == 24
    third = kept.pin(there)
    assert kept.prune() == [first] and kept.current(there) == third and kept.tables(second)[1].count() == 36
    server.products.clear()
    assert kept.pin(there, refresh=True) is None and kept.current(there) == third


def test_sources_are_replaced_one_by_one(spark, tmp_path):
    row = lambda source, k, q=1: (source, "c", f"{source}{k}", "M", q, "instock", f"f!R{k}", k)
    kind = "source string, category string, source_product string, size string, quantity long, availability string, source_ref string, row int"
    folder = f"{tmp_path}/unified"
    with pytest.raises(FileNotFoundError):
        store.read_sources(spark, folder)
    store.write_sources(spark.createDataFrame([row("B", k) for k in (3, 1, 2)] + [row("A", 7, 0)], kind), folder, ["A", "B"], ["row"])
    got = lambda: [(r["ord"], r["source_product"], r["quantity"]) for r in store.read_sources(spark, folder).orderBy("ord").collect()]
    assert got() == [(1, "A7", None), (2, "B1", 1), (3, "B2", 1), (4, "B3", 1)]
    store.write_sources(spark.createDataFrame([row("C", 5)], kind), folder, ["C", "A"], ["row"])
    assert got() == [(1, "B1", 1), (2, "B2", 1), (3, "B3", 1), (4, "C5", 1)] and store.stored_sources(spark, folder) == ["B", "C"]


def test_runs_from_workbook_to_shop_and_back(spark, server, tmp_path):
    rows = [["", f"S{k}", size, q] for k in (1, 3, 5) for size, q in (("S", 0), ("M", 8), ("XXL", 2))] + [["", "unknown", "M", 1]]
    path = workbook.write_book(f"{tmp_path}/in.xlsx", [("sheet", ["", "p", "s", "q"], rows)])
    settings = files.configuration(given={"store": {"base_url": server.url, "per_page": 4, "pause": 0.01}, "paths": {"output_dir": f"{tmp_path}/out", "mapping_file": f"{tmp_path}/rules.csv"}, "sources": [{"id": "SP5", "label": "five", "file": path, "options": {"quantity_column": "D", "start_row": 2}}, {"id": "ALO", "file": path, "options": {"start_row": 11}}]}, environment={})
    work = runs.Work(spark, settings)
    assert [tuple(r) for r in runs.run_extract(work).collect()] == [("SP5", "five", 10, 4), ("ALO", "ALO", 1, 1)]
    diffs = runs.run_diff(work, "d1")
    count = {r["status"]: r["count"] for r in diffs.groupBy("status").count().collect()}
    assert count == {reconcile.CHANGED: 6, reconcile.NO_VARIATION: 3, reconcile.UNMATCHED: 2}
    assert files.read_rules(spark, f"{tmp_path}/rules.csv").count() == 5  # suggestions for each product of each source
    before = json.dumps(server.variations)
    rehearsed = runs.run_sync(work, "r0")
    assert {r["result"] for r in rehearsed.collect()} == {sync.REHEARSED} and not server.puts
    results = runs.run_sync(work, "r1", sources=["sp5"], answer="YES", writers=2)
    assert {r["result"] for r in results.collect()} == {sync.DONE} and results.count() == 6 and {v["stock_quantity"] for k in (1, 3, 5) for v in server.variations[k]} == {0, 8, 2}
    assert work.catalogue.current(work.shop) is None  # forgotten after the writes
    assert runs.run_diff(work, "d2").where(F.col("status") == reconcile.CHANGED).isEmpty()
    runs.run_rollback(work, "r1", confirmed=True)
    assert json.dumps(server.variations) == before and work.catalogue.current(work.shop) is None
    assert {r["source_product"]: r["parent_sku"] for r in runs.run_map(work, write=True).collect()}["S3"] == "S3"
    with pytest.raises(ValueError):
        runs.run_extract(work, ["none"])
