"""Sources, diff, reports, write-back and pick-sheets on small fixtures with hand-made results."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import extract, match, ordered, pallet, reconcile, report, sync
from stocktide.sinks import text as text_sinks
from stocktide.sinks import workbook
from stocktide.sources import files, shop, xlsx
from stocktide.storage import stored

PRODUCTS = [(1, 1, "192SU-22-4410F", "Web Hoodie / Black", "variable"), (2, 2, "ABC123F", "灰色 圆领 T-shirt", "variable"), (3, 3, "XYZ9999 QWE5555", "Set of two", "variable"), (4, 4, "ABC124", "Simple", "simple")]
VARIATIONS = [
    (1, 0, 11, "a", ["Black", "M"], "true", 5, "instock"), (1, 1, 12, "b", ["2XL"], "true", 3, "instock"), (1, 2, 13, "c", ["L"], "false", None, "outofstock"), (1, 3, 14, "d", ["S"], "true", 0, "outofstock"),
    (2, 0, 21, "e", ["M"], "true", None, "instock"), (3, 0, 31, "f", ["M"], "parent", 4, "onbackorder"),
]
RULES = [("SP5", "", "Brown#2", "abc-123-FF", "", 1), ("*", "c", "Brown#1", "", "", 2), ("*", "*", "Brown#1", "192SU224410", "", 3), ("SP5", "c", "lost", "nothere", "", 4), ("SP5", "c", "mapped", "192su224410", "L:2XL;L:M", 5)]
ROWS = [
    (1, "SP5", "c", "192SU-22-4410", "M", 5, "instock"), (2, "SP5", "c", "192SU-22-4410", "xxl", 9, "instock"), (3, "SP5", "c", "192SU-22-4410", "L", 2, "instock"), (4, "SP5", "c", "192SU-22-4410", "S", None, "instock"),
    (5, "SP5", "c", "192SU-22-4410", "XS", 1, "instock"), (6, "SP5", "c", "Brown", "M", 1, "instock"), (7, "SP5", "c", "x", "M", 1, "instock"), (8, "SP5", "c", "Brown", "M", 4, "instock"),
    (9, "SP5", "c", "lost", "M", 4, "instock"), (10, "SP5", "c", "mapped", "L", None, "outofstock"), (11, "SP5", "c", "灰色圆领ｔ－ｓｈｉｒｔ", "Ｍ码", 7, "instock"), (12, "SP5", "c", "QWE5555", "M", 4, "instock"),
]


@pytest.fixture(scope="module")
def shop_tables(spark):
    products = spark.createDataFrame(PRODUCTS, files.PRODUCTS)
    variations = spark.createDataFrame(VARIATIONS, files.VARIATIONS)
    rules = spark.createDataFrame(RULES, "source string, category string, product string, parent_sku string, size_map string, ord long")
    rows = spark.createDataFrame([(*r, f"f!R{r[0]}") for r in ROWS], "ord long, source string, category string, source_product string, size string, quantity long, availability string, source_ref string")
    return rows, products, variations, rules


def one(spark, value, kind, *functions):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*[f(F.col("x")).alias(f"c{k}") for k, f in enumerate(functions)]).first())


@pytest.mark.parametrize("raw, sku, name", [("192SU-22-4410", "192SU224410", "192su224410"), ("SP5-H-BROWN-BBV2/XS", "SP5HBROWNBBV2XS", "sp5hbrownbbv2xs"), ("AB①２-Ⅳ㎏", "AB12IVKG", "ab12ivkg"), ("Ｗｅｂ　Ｔ恤…", "WEBT", "webt恤"), (None, "", "")])
def test_compatibility_forms(spark, raw, sku, name):
    assert one(spark, raw, "string", text.normalize_sku, text.normalize_name) == (sku, name)


def test_scalars(spark):
    for raw, want in (("1,234", 1234), ("3.9", 3), ("-3.9", -3), ("x", None), (" ", None), ("12f", None), ("12d", None), ("1e3", 1000), ("inf", None), ("1_000", 1000), (None, None)):
        assert one(spark, raw, "string", text.to_int) == (want,), raw
    assert one(spark, True, "boolean", text.to_int) == (1,) and one(spark, -2.7, "double", text.to_int) == (-2,) and one(spark, 1 << 60, "long", text.to_int) == (1 << 60,)
    for raw, want in (("XXL:2XL; L:XL; XL:Extra Large", {"XXL": "2XL", "L": "XL", "XL": "Extra Large"}), ("M:1;M:", {"M": "1"}), ("L：XL", {}), ("2XL:a；xxl:b", {"XXL": "b"}), (None, {})):
        assert one(spark, raw, "string", text.size_map) == (want,), raw
    for raw, want in (("", [""]), ("，；", [" ,;".strip()]), ("A F，B", ["A", "F", "B"]), (None, [])):
        assert one(spark, raw, "string", text.split_sku_field) == (want,), raw
    assert [text.column_number(x) for x in ("A", "z", " AA ")] == [1, 26, 27]
    with pytest.raises(ValueError):
        text.column_number("1")
    words = spark.createDataFrame([(["Web", "灰色", "（a", "（", "b", ""],)], "w array<string>").select(text.joined_words(F.col("w"))).first()[0]
    assert words == "Web灰色（a （b"
    assert one(spark, "<a & 'b'>", "string", text.html_escaped) == ("&lt;a &amp; &#x27;b&#x27;&gt;",)


def test_diff_from_rows_to_actions(shop_tables):
    got = {r["ord"]: r for r in reconcile.build_diff(*shop_tables, combos=True).collect()}
    assert len(got) == len(ROWS) and set(reconcile.COLUMNS) < set(next(iter(got.values())).asDict())
    seen = lambda k: tuple(got[k][c] for c in ("status", "variation_id", "qty_delta", "action", "match_method"))
    assert seen(1) == (reconcile.SAME, 11, 0, "无需更新", match.SKU) and got[1]["note"] == reconcile.NOTE_SAME
    assert seen(2) == (reconcile.CHANGED, 12, 6, "数量 3 → 9；状态 有货 → 有货", match.SKU)
    assert seen(3) == (reconcile.CHANGED, 13, None, "状态 缺货 → 有货", match.SKU)
    assert seen(4) == (reconcile.NEED_QTY, 14, None, reconcile.BY_HAND, match.SKU)
    assert seen(5) == (reconcile.NO_VARIATION, None, None, reconcile.BY_HAND, match.SKU) and got[5]["parent_sku"] == "192SU-22-4410F" and not got[5]["manages_stock"]
    assert seen(6)[0] == reconcile.UNMATCHED  # the exact rule is blank and shadows the filled wildcard
    assert seen(7)[0] == reconcile.UNMATCHED and got[7]["note"] == reconcile.NOTE_UNMATCHED
    assert seen(8) == (reconcile.CHANGED, 21, None, "数量 None → 4；状态 有货 → 有货", match.RULE)
    assert seen(9)[0] == reconcile.NO_PRODUCT and got[9]["note"] == reconcile.NOTE_RULE_MISSING
    assert seen(10) == (reconcile.CHANGED, 11, None, "数量 5 → 0；状态 有货 → 缺货", match.RULE)
    assert seen(11) == (reconcile.CHANGED, 21, None, "数量 None → 7；状态 有货 → 有货", match.NAME)
    assert seen(12) == (reconcile.CHANGED, 31, 0, "数量 4 → 4；状态 onbackorder → 有货", match.COMBO)
    assert {r["match_method"] for r in reconcile.build_diff(*shop_tables).where("ord = 12").collect()} == {match.NONE}


def test_nearest_identifiers(spark, shop_tables):
    products = spark.createDataFrame([(1, 1, "ABC123F"), (2, 2, "ABD123"), (3, 3, "ABC124"), (4, 4, "XYZ9999 QWE5555"), (5, 5, "zz-77-aa-77"), (6, 6, "K" * 50 + "1")], "id long, ord long, sku string")
    wanted = spark.createDataFrame([("abc-123",), ("QWE5555",), ("7q7q7q7qqqqq",), ("K" * 25 + "x" + "K" * 25,), ("",), (None,)], "key string")
    got = [(r["key"], r["id"], r["combo"], r["distance"], r["place"]) for r in match.nearest_sku(wanted, products).orderBy("key", "place").collect()]
    assert [x for x in got if x[0] == "abc-123"] == [("abc-123", 1, False, 1, 1), ("abc-123", 2, False, 1, 2), ("abc-123", 3, False, 1, 3)]
    assert [x for x in got if x[0] == "QWE5555"] == [("QWE5555", 4, True, 0, 1)]
    assert [x[1] for x in got if x[0].startswith("7q")] == [5] and [x[1] for x in got if x[0].startswith("K")] == [6] and len(got) == 6


def test_suggestions(shop_tables):
    rows, products, _, rules = shop_tables
    keyed = ordered.dense_occurrence_keys(rows.withColumnRenamed("source_product", "product"), "product", ["source", "category", "product"], "ord")
    got = {r["source_product"]: (r["parent_sku"], r["note"]) for r in match.suggestions(keyed, products, rules).collect()}
    assert got["Brown#2"] == ("ABC123F", match.RULE) and got["Brown#1"] == ("", match.TO_FILL) and got["lost"] == ("nothere", match.TO_FILL) and got["192SU-22-4410"] == ("192SU-22-4410F", match.SKU)


def test_a_failed_run_can_be_rolled_back(spark, shop_tables, tmp_path):
    _, _, variations, _ = shop_tables
    diffs = stored(reconcile.build_diff(*shop_tables), "diff")
    plan = sync.planned(reconcile.select_changes(diffs), variations.where("id <> 13"))
    folder = str(tmp_path)

    def send(product, variation, payload):
        if variation == 21:
            raise RuntimeError("shop says no " + "x" * 500)
        with open(f"{folder}/{variation}.json", "a") as f:
            f.write(json.dumps(payload) + "\n")
        return {"sku": "s", **payload}

    results, images = sync.apply_updates(plan, send)
    got = {r["ord"]: r for r in results.collect()}
    assert {k: r["result"] for k, r in got.items()} == {2: sync.DONE, 3: sync.SKIPPED, 8: sync.FAILED, 10: sync.DONE, 11: sync.FAILED}
    assert len(got[8]["error"]) == 400 and got[3]["error"] == sync.NO_VARIATION
    assert sync.totals(results).first().asDict() == {"total": 5, "success": 2, "failed": 2, "skipped": 1}
    assert open(f"{folder}/12.json").read() == '{"manage_stock": true, "stock_quantity": 9, "stock_status": "instock"}\n'
    kept = sync.kept_entries(images, results)
    path = text_sinks.write_snapshot(kept, f"{folder}/snapshot", "shop", "now", False)
    entries = files.read_snapshot(spark, path)
    assert [(r["variation_id"], r["before"]["stock_quantity"], r["before"]["stock_status"]) for r in entries.orderBy("variation_id").collect()] == [(11, "5", '"instock"'), (12, "3", '"instock"')]
    back, totals = sync.rollback(entries, send)
    assert [r["result"] for r in back.collect()] == [sync.DONE] * 2 and totals.first().asDict() == {"total": 2, "success": 2, "failed": 0, "skipped": 0}
    assert open(f"{folder}/12.json").read().splitlines()[-1] == '{"manage_stock": true, "stock_quantity": 3, "stock_status": "instock"}'
    rehearsed, _ = sync.apply_updates(plan)
    assert sync.totals(rehearsed).first().asDict() == {"total": 5, "success": 0, "failed": 0, "skipped": 5} and not sync.may_write() and sync.may_write(answer=" yes ")
    assert sync.rollback(entries)[1].first()["skipped"] == 2
    log = workbook.write_sync_log(results, f"{folder}/log.xlsx")
    assert xlsx.read_cells(spark, log).where("sheet = '同步结果'").groupBy("row").count().count() == 6
    line = {r["parent_sku"]: r for r in sync.by_product(results).collect()}["192SU-22-4410F"]
    assert (line["n"], line["ok"], line["fail"]) == (3, 2, 0) and "数量=3 状态=有货 管理库存=是 → {" in line["changes"]


def test_reports(spark, shop_tables, tmp_path):
    _, products, _, _ = shop_tables
    diffs = stored(reconcile.build_diff(*shop_tables), "diff")
    shown = {r["ord"]: r for r in report.present(diffs).collect()}
    assert shown[2]["mark_quantity"] and not shown[2]["mark_status"] and shown[3]["mark_status"] and shown[5]["变体 ID"] == "" and shown[1]["在线库存状态"] == "有货"
    todo = {r["source_product"]: r for r in report.todo(diffs, products).collect()}
    assert (todo["192SU-22-4410"]["sizes"], todo["192SU-22-4410"]["n_sizes"], todo["QWE5555"]["near_sku"]) == ("S、XS", 2, "XYZ9999 QWE5555（组合款）")
    moved = {r["source_product"]: r["items"] for r in report.changes_by_product(diffs).collect()}
    assert moved["192SU-22-4410"] == "xxl: 3→9、L: -→2" and moved["Brown"] == "M: -→4"
    book = workbook.write_diff(diffs, products, f"{tmp_path}/diff.xlsx", {"店铺": "x"})
    counts = {r["sheet"]: r["n"] for r in xlsx.read_cells(spark, book).groupBy("sheet").agg(F.count_distinct("row").alias("n")).collect()}
    assert counts["差异明细"] == 6 and counts["无差异"] == 2 and counts["需人工处理"] == 7 and counts["待处理商品清单"] == 6
    import re
    import zipfile

    sheets = [zipfile.ZipFile(book).read(f"xl/worksheets/sheet{k}.xml").decode() for k in (1, 2, 3, 4)]
    looks = [{k: len(re.findall(f' s="{n}"', x)) for k, n in workbook.STYLE.items()} for x in sheets]
    assert looks[0] == {"head": 17, "changed": 5 * 17 - 7, "marked": 7, "same": 0, "manual": 0} and looks[1]["same"] == 17 and looks[2]["manual"] == 6 * 17 and looks[3]["head"] == 8
    page = open(text_sinks.write_html(diffs, products, f"{tmp_path}/d.html")).read()
    assert page.count("class=chg") == 25 and "数量 3 → 9" in page
    assert "xxl: 3→9" in open(text_sinks.write_markdown(diffs, f"{tmp_path}/d.md")).read()
    shown_ = text_sinks.preview_text(diffs, 2, 2).split("\n")
    assert shown_[0] == "有差异 5，一致 1，需人工处理 6" and shown_[3] == "SP5 · c · 192SU-22-4410 · 2" and shown_[5] == "另有 3" and shown_[-3] == "192SU-22-4410 · xxl · 192SU-22-4410F · 3 → 9 · 有货 → 有货" and shown_[-1] == "另有 3"
    said = open(text_sinks.write_markdown(diffs, f"{tmp_path}/e.md")).read()
    assert "| Brown | M | 未能匹配 | " in said and "| SP5 | c | 192SU-22-4410 | Web Hoodie / Black（192SU-22-4410F） | xxl: 3→9、L: -→2 |" in said
    text_sinks.write_json(diffs, f"{tmp_path}/diff-json")
    assert spark.read.json(f"{tmp_path}/diff-json").count() == len(ROWS)


def test_workbooks_there_and_back(spark, tmp_path):
    sheet = [["", "商品", "尺码", "数量"], ["", "A", "M", 3.0], ["", None, "M", 4], ["", None, " ", 5], ["", None, "L", None], ["", "B", "m", "✅"], ["", 12.0, "S", "0"], ["", "A", "M", "1,5x"]]
    path = workbook.write_book(f"{tmp_path}/in.xlsx", [("one", sheet[0], sheet[1:]), ("two", ["x"], [])])
    cells = xlsx.read_cells(spark, path)
    assert cells.where("sheet = 'two'").count() == 1
    merges = spark.createDataFrame([("in.xlsx", "one", 5, 6, 4, 4)], xlsx.MERGES)
    got = extract.table_rows(cells.where("sheet = 'one'"), merges, extract.Sheet("SP5", quantity="D", start=2)).orderBy("row").collect()
    assert [(r["source_product"], r["size"], r["quantity"], r["availability"]) for r in got] == [("A", "M", 3, "instock"), ("A", "L", None, "outofstock"), ("B", "M", None, "instock"), ("12", "S", 0, "outofstock"), ("A", "M", None, "instock")]
    assert got[0]["source_ref"] == "in.xlsx!one!R2"
    top = extract.read_cells(cells.where("sheet = 'one'"), spark.createDataFrame([("in.xlsx", "one", 2, 3, 2, 2)], xlsx.MERGES)).where("row = 3 and col = 2").first()
    assert top["value"] == "A"
    source = {"id": "SP5", "file": path, "options": {"quantity_column": "D", "start_row": 2}}
    rows = extract.union_sources([files.read_source(spark, source), files.read_source(spark, {**source, "id": "ALO"})], None)
    numbered = extract.numbered(stored(rows, "rows"), ["source", "file", "row"])
    assert sorted(r["ord"] for r in numbered.collect()) == list(range(1, 11))
    assert extract.union_sources([rows], ["ALO"]).count() == 5
    written = workbook.write_unified(numbered, str(tmp_path))
    assert len(written) == 3
    again = files.read_unified(spark, str(tmp_path))
    assert again.count() == 10 and again.where("source_product = '12'").first()["quantity"] is None
    stats = extract.source_stats(numbered)
    baseline = spark.createDataFrame([("SP5", 5, 3), ("PALLET", 1, 1)], "source string, n_rows long, products long")
    assert {r["source"]: r["verdict"] for r in extract.against_baseline(stats, baseline).collect()} == {"SP5": "ok", "ALO": "skipped"}
    with pytest.raises(ValueError):
        files.read_source(spark, {**source, "adapter": "other"})
    with pytest.raises(FileNotFoundError):
        files.read_source(spark, {**source, "file": f"{tmp_path}/none.xlsx"})


def test_rules_and_catalogue_files(spark, tmp_path):
    path = f"{tmp_path}/rules.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('source,category,source_product,parent_sku,size_map,note\nA,, p1 ,x,,"two\nlines"\nA,*,p1,y,,\nA,c,,z,,\n')
    rules = files.read_rules(spark, path)
    assert [(r["category"], r["product"], r["parent_sku"]) for r in rules.orderBy("ord").collect()] == [("*", "p1", "x"), ("*", "p1", "y")]
    assert files.read_rules(spark, f"{tmp_path}/none.csv").count() == 0
    assert extract.rule_report(rules).first().asDict() == {"rules": 2, "filled": 2, "duplicates": 1, "first_duplicates": ["A|*|p1"]}
    kept = text_sinks.write_rules(rules.withColumnRenamed("product", "source_product"), f"{tmp_path}/out.csv")
    assert open(kept, "rb").read(3) == b"\xef\xbb\xbf" and files.read_rules(spark, kept).count() == 2
    catalogue = f"{tmp_path}/catalogue.json"
    json.dump({"base_url": "b", "products": [{"id": 1, "sku": "s", "type": "variable"}, {"id": 2, "type": "simple"}], "variations": {"1": [{"id": 5, "attributes": [{"name": "size", "option": "M"}], "manage_stock": "parent", "stock_quantity": 3}], "2": [{"id": 6}]}}, open(catalogue, "w"))
    products, variations = files.read_catalogue(spark, catalogue, "b")
    assert products.count() == 2 and [(r["id"], r["options"], r["manage_stock"]) for r in variations.collect()] == [(5, ["M"], "parent")]
    assert files.read_catalogue(spark, catalogue, "other") is None and files.read_catalogue(spark, f"{tmp_path}/no.json") is None
    baseline = f"{tmp_path}/baseline.json"
    json.dump({"sources": {"A": {"rows": 3, "products": 2}}, "total_rows": 3}, open(baseline, "w"))
    assert files.read_baseline(spark, baseline).first().asDict() == {"source": "A", "n_rows": 3, "products": 2, "total_rows": 3}
    settings = files.configuration(None, {"sync": {"mode": "status"}}, {files.KEYS_FROM["consumer_key"]: "k"})
    assert settings["sync"] == {"mode": "status", "update_status": True, "no_qty_policy": "status_and_zero"} and settings["store"]["consumer_key"] == "k" and settings["options"]["fuzzy_threshold"] == 0.86


def test_shop_pages_retries_and_updates(spark, tmp_path):
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def reply(self, code, value):
            body = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            asked.append(self.path)
            page = int(self.path.split("page=")[-1].split("&")[0])
            if len(asked) == 1:
                return self.reply(503, "later")
            if "/variations" in self.path:
                return self.reply(200, [{"id": 7, "attributes": [{"option": "M"}], "manage_stock": True, "stock_quantity": 2, "stock_status": "instock"}] if page == 1 else [])
            every = [{"id": k, "sku": f"s{k}", "name": "n", "type": "variable" if k == 1 else "simple"} for k in (1, 2, 3)]
            return self.reply(200, every[2 * page - 2 : 2 * page])

        def do_PUT(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.reply(200, {"sku": "s"}) if self.path.endswith("/7") else self.reply(404, "none")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        there = shop.Shop(f"http://127.0.0.1:{server.server_port}", "k", "s", per_page=2, pause=0.01)
        products, variations = shop.catalogue(spark, there, f"{tmp_path}/cache")
        assert [r["id"] for r in products.orderBy("ord").collect()] == [1, 2, 3]
        assert [(r["product_id"], r["id"], r["options"], r["manage_stock"]) for r in variations.collect()] == [(1, 7, ["M"], "true")]
        n = len(asked)
        assert shop.catalogue(spark, there, f"{tmp_path}/cache")[0].count() == 3 and len(asked) == n
        assert there.send(1, 7, {}) == {"sku": "s"}
        with pytest.raises(shop.ShopError):
            there.send(1, 8, {})
        shop.forget(spark, f"{tmp_path}/cache")
        assert shop.catalogue(spark, there, f"{tmp_path}/cache")[1].count() == 1 and len(asked) > n
    finally:
        server.shutdown()


def test_pick_sheet(spark):
    word = lambda text_, x, top: (1, text_, float(x), float(top), 10.0)
    words = [word("卫衣", 20, 52), word("hoodie", 60, 52), word("裤子", 420, 52), word("192SU-22-4410", 100, 120), word("Web", 90, 100), word("Hoodie", 110, 100), word("灰色", 100, 210), word("✅", 330, 100)]
    words += [word(s, 300 + k % 2, 100 + 20 * k) for k, s in enumerate(("S", "M", "L"))] + [word(s, 300, 200 + 20 * k) for k, s in enumerate(("S", "M", "2XL"))] + [word(s, 700, 100 + 20 * k) for k, s in enumerate(("S", "M"))]
    words += [word("短裤", 20, 302)] + [word(s, 300, 350 + 20 * k) for k, s in enumerate(("XS", "S", "M"))] + [word("130BT-21-2020", 50, 900)]
    rects = [(1, 0.0, 380.0, 50.0, 64.0, 0.8), (1, 400.0, 790.0, 51.0, 64.0, 0.8), (1, 0.0, 790.0, 300.0, 314.0, 0.7), (1, 0.0, 100.0, 330.0, 340.0, 0.8), (1, 0.0, 790.0, 340.0, 345.0, 0.2)]
    cells = [(1, 300.0, 93.5, 116.5, 80), (1, 300.0, 120.0, 130.0, 0), (1, 300.0, 193.5, 216.5, 61), (1, 300.0, 343.5, 366.5, 20)]
    words = spark.createDataFrame(words, "page int, text string, x0 double, top double, height double")
    rects = spark.createDataFrame(rects, "page int, x0 double, x1 double, top double, bottom double, fill double")
    cells = spark.createDataFrame(cells, "page int, col_x0 double, y_lo double, y_hi double, green_count int")
    rows = pallet.inventory(words, rects, cells, "PALLET", "p.pdf", drop_unidentified=False).orderBy("row")
    got = [(r["category"], r["source_product"], r["size"], r["availability"]) for r in rows.collect()]
    assert got[:3] == [("卫衣 hoodie", "192SU-22-4410", "S", "instock"), ("卫衣 hoodie", "192SU-22-4410", "M", "outofstock"), ("卫衣 hoodie", "192SU-22-4410", "L", "outofstock")]
    assert got[3:6] == [("卫衣 hoodie", "灰色", "S", "instock"), ("卫衣 hoodie", "灰色", "M", "outofstock"), ("卫衣 hoodie", "灰色", "XXL", "outofstock")]
    assert got[6:] == [("短裤｜左", "", "XS", "outofstock"), ("短裤｜左", "", "S", "outofstock"), ("短裤｜左", "", "M", "outofstock")]
    assert pallet.inventory(words, rects, cells, "PALLET").count() == 6
    assert rows.collect()[0]["source_ref"] == "p.pdf|主表|栏1|块1|S"
    assert [r["sku"] for r in pallet.orphans(words, rows).collect()] == ["130BT-21-2020"] and [r["sku"] for r in pallet.all_skus(words).orderBy("first").collect()] == ["192SU-22-4410", "130BT-21-2020"]
    assert pallet.mark_quality(rows).first().asDict() == {"blank": 6, "marked": 2, "ambiguous": 1}
    assert pallet.sections(words, rects.where("fill < 0"), spark.createDataFrame([(1, 800.0)], "page int, height double")).first()["name"] == "主表"


def test_marks_of_rendered_strips(spark):
    """Windows from running totals against sums over the pixels; strips that are no pixmaps are errors."""
    import numpy as np

    rng = np.random.default_rng(1)
    rgb = rng.choice(np.array([[0, 200, 0], [255, 255, 255], [120, 130, 100], [0, 0, 0], [10, 121, 80]], np.uint8), (500, 7))
    image = b"P6\n# made here\n7 500\n255\n" + rgb.tobytes()
    index = pallet.mark_index(spark.createDataFrame([(1, 1, 1, 40.0, 200, bytearray(image))], "page int, section long, column int, y_top double, dpi int, image binary"))
    r, g, b = (rgb[..., k].astype(int) for k in range(3))
    green = (g > 120) & (g > r + 40) & (g > b + 40)
    windows = spark.createDataFrame([(float(y), float(y + h)) for y in range(20, 240, 7) for h in (0, 1, 23)], "lo double, hi double")
    for w in windows.crossJoin(index).select("lo", "hi", pallet.green_between(F.col("lo"), F.col("hi")).alias("green")).collect():
        a, z = (int(round((y - 40.0) / 72.0 * 200)) for y in (w["lo"], w["hi"]))
        assert w["green"] == int(green[max(0, a) : max(0, min(500, z))].sum())
    for bad in (b"P5\n1 1\n255\nx", b"P6\n1 1\n65535\nxxxxxx"):
        with pytest.raises(ValueError):
            pallet.pixels(bad)


def test_pick_sheet_with_strips(spark):
    """The same page with marks from a strip: two sizes have a green mark in their window."""
    import numpy as np

    words = [(1, s, 300.0, 100.0 + 25 * k, 10.0) for k, s in enumerate(("S", "M", "L", "XL"))] + [(1, "192SU-22-4410", 100.0, 120.0, 10.0)]
    words = spark.createDataFrame(words, "page int, text string, x0 double, top double, height double")
    rects = spark.createDataFrame([], "page int, x0 double, x1 double, top double, bottom double, fill double")
    rgb = np.full((600, 10, 3), 255, np.uint8)
    for mid, rows in ((105, 8), (155, 8), (180, 5)):
        at = round(mid / 72 * 200)
        rgb[at : at + rows] = (0, 200, 0)
    strips = spark.createDataFrame([(1, 1, 1, 0.0, 200, bytearray(b"P6 10 600 255\n" + rgb.tobytes()))], "page int, section long, column int, y_top double, dpi int, image binary")
    rows = stored(pallet.inventory(words, rects, source="PALLET", file="p.pdf", marks=pallet.mark_index(strips)), "rows")
    assert [(r["size"], r["green"], r["availability"]) for r in rows.orderBy("row").collect()] == [("S", 80, "instock"), ("M", 0, "outofstock"), ("L", 80, "instock"), ("XL", 50, "outofstock")]
    assert pallet.sheet_stats(words, rows).first().asDict() == {"n_rows": 4, "products": 1, "orphan_skus": []}
