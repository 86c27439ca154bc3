"""Write-back as one guarded unit: durable images, repeated tasks, broken-off runs, and the way back from a new session."""

import json
import os
import subprocess
import sys
from collections import Counter
from copy import deepcopy
from pathlib import Path

import pytest
from shop_server import ShopServer

from stocktide.operators import extract, reconcile, sync
from stocktide.sinks import text as text_sinks
from stocktide.sinks import updates, workbook
from stocktide.sources import files, xlsx
from stocktide.sources.shop import Shop
from stocktide.storage import stored

PLAN = "ord bigint, source_product string, size string, parent_sku string, product_name string, product_id bigint, variation_id bigint, before struct<sku:string,manage_stock:string,stock_quantity:bigint,stock_status:string>, payload struct<manage_stock:boolean,stock_quantity:bigint,stock_status:string>"
OLD = {"sku": "v", "manage_stock": True, "stock_quantity": 3, "stock_status": "instock"}


def plan_rows(n):
    return [(k, "p", "M", f"S{k % 5}", "name", 1, k, ("v", "true", 3, "instock"), (True, k + 10, "instock")) for k in range(1, n + 1)]


@pytest.fixture()
def shop():
    server = ShopServer([{"id": 1, "sku": "s", "name": "n", "type": "variable"}], {1: [{"id": k, **OLD} for k in range(1, 61)]})
    yield server
    server.close()


def there(shop):
    return Shop(shop.url, pause=0.01, attempts=1)


def test_nothing_is_sent_without_a_yes(spark, tmp_path, shop):
    ledger, plan = sync.Ledger(spark, str(tmp_path)), spark.createDataFrame(plan_rows(5), PLAN)
    forgotten = []
    results = sync.write_back(ledger, "a", plan, there(shop).send, answer="no", forget=lambda: forgotten.append(1))
    assert {r["result"] for r in results.collect()} == {sync.REHEARSED} and not shop.puts and not forgotten
    assert ledger.entries("a").count() == 5  # a rehearsal's snapshot has all
    with pytest.raises(ValueError):
        sync.write_back(ledger, "a", plan, there(shop).send, confirmed=True)
    with pytest.raises(LookupError):
        sync.resume(ledger, "unknown", there(shop).send, confirmed=True)
    results = sync.write_back(ledger, "b", plan, there(shop).send, answer=" yes ", forget=lambda: forgotten.append(1))
    assert {r["result"] for r in results.collect()} == {sync.DONE} and len(shop.puts) == 5 and forgotten == [1]
    sync.undo(ledger, "b", there(shop).send, forget=lambda: forgotten.append(2))
    assert len(shop.puts) == 5 and forgotten == [1]
    back, totals = sync.undo(ledger, "b", there(shop).send, confirmed=True, forget=lambda: forgotten.append(2))
    assert totals.first().asDict() == {"total": 5, "success": 5, "failed": 0, "skipped": 0} and forgotten == [1, 2]
    assert shop.variations[1][:5] == [{"id": k, **OLD} for k in range(1, 6)]


def test_images_are_written_before_the_first_send(spark, tmp_path):
    ledger, folder = sync.Ledger(spark, str(tmp_path)), str(tmp_path)

    def send(product, variation, payload):
        if not os.path.exists(f"{folder}/images/run_id=a/_SUCCESS"):
            raise RuntimeError("no way back")
        return payload

    results = sync.write_back(ledger, "a", spark.createDataFrame(plan_rows(7), PLAN), send, confirmed=True)
    assert {r["result"] for r in results.collect()} == {sync.DONE}


def test_the_plan_is_not_read_again_after_writes(spark, tmp_path, shop):
    """The catalogue is read lazily from the shop; images hold what was there before the writes."""
    from stocktide.sources.shop import products, variations

    changes = spark.createDataFrame([(k, "p", "M", "S", "n", 1, k, 9, "instock", 3, "instock", True) for k in range(1, 11)], "ord long, source_product string, size string, parent_sku string, product_name string, product_id long, variation_id long, src_qty long, src_status string, store_qty long, store_status string, managed boolean")
    plan = sync.planned(changes.drop("managed"), variations(products(spark, there(shop)), there(shop)))
    results, images = sync.apply_updates(plan, there(shop).send)
    assert {r["before"]["stock_quantity"] for r in results.collect()} == {3} and {r["before"]["stock_quantity"] for r in images.collect()} == {"3"}
    assert {v["stock_quantity"] for v in shop.variations[1][:10]} == {9}


def test_a_repeated_task_sends_nothing_twice(spark, tmp_path, shop):
    """The writer's first attempt dies after some chunks; the second reads the ledger and the shop."""
    from pyspark.sql import Row

    class Killed(BaseException):
        pass

    sends = Counter()

    def send(product, variation, payload):
        sends[variation] += 1
        after = there(shop).send(product, variation, payload)
        if sum(sends.values()) == 10:
            raise Killed  # the tenth is sent, but its outcome is never written
        return after

    rows = [Row(product_id=1, variation_id=k, request=json.dumps({"stock_quantity": 40 + k})) for k in range(1, 21)]
    writer = updates.UpdateWriter(send, str(tmp_path), 4, there(shop).variation)
    import pyspark.taskcontext as tc

    class Here:
        def partitionId(self):
            return 2

    before, tc.TaskContext._taskContext = tc.TaskContext._taskContext, Here()
    try:
        with pytest.raises(Killed):
            writer.write(iter(rows))
        message = writer.write(iter(rows))
    finally:
        tc.TaskContext._taskContext = before
    assert set(sends.values()) == {1} and len(sends) == 20 and len(shop.puts) == 20
    assert (message.sent, message.repeated, message.failed) == (10, 10, 0)
    found = updates.outcomes(spark, str(tmp_path)).collect()
    assert sorted(r["variation_id"] for r in found) == list(range(1, 21)) and all(r["ok"] and r["after"]["stock_quantity"] == 40 + r["variation_id"] for r in found)


RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from stocktide.operators import sync
from stocktide.sources.shop import Shop
plan = spark.createDataFrame({rows!r}, {schema!r})
sync.write_back(sync.Ledger(spark, {folder!r}), "nightly", plan, Shop({url!r}, attempts=1).send, confirmed=True, writers=2, chunk=4)
"""


def test_a_killed_run_is_taken_back_and_gone_on_with_from_a_new_session(spark, tmp_path, shop):
    """The whole application is killed while it sends; this session knows only the run's id."""
    root = str(Path(__file__).resolve().parent.parent)
    folder, before = str(tmp_path / "ledger"), deepcopy(shop.variations)
    code = RUN.format(root=root, rows=plan_rows(60), schema=PLAN, folder=folder, url=shop.url)
    run = subprocess.Popen([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": root}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    shop.on_put = lambda n: os.killpg(run.pid, 9) if n == 23 else None
    assert run.wait(180) == -9
    shop.on_put = lambda n: None
    sent = {v for v, _ in shop.puts}
    assert 20 <= len(sent) < 60 and shop.variations != before
    ledger = sync.Ledger(spark, folder)
    known = {str(r["variation_id"]) for r in ledger.entries("nightly").collect()}
    assert sent <= known  # every send was announced before, and whatever was announced has its image
    _, totals = sync.undo(ledger, "nightly", there(shop).send, confirmed=True)
    assert shop.variations == before and totals.first()["failed"] == 0
    shop.puts.clear()
    results = sync.resume(ledger, "nightly", there(shop).send, confirmed=True)
    assert results.count() == 60 and {r["result"] for r in results.collect()} == {sync.DONE}
    assert max(Counter(v for v, _ in shop.puts).values()) == 1


def test_only_fields_of_the_image_go_back(spark, tmp_path):
    """Entries as they may stand in a snapshot: fields that are absent stay absent, null is a value, and empty images are left out."""
    entries = [
        {"product_id": 1, "variation_id": 11, "sku": "a", "before": {"stock_status": "instock"}},
        {"product_id": 1, "variation_id": 12, "sku": "b", "before": {"sku": "x", "manage_stock": "parent", "stock_quantity": None, "stock_status": "in\"st"}},
        {"product_id": 1, "variation_id": 13, "sku": "c", "before": {"sku": "x"}}, {"product_id": 1, "variation_id": 14, "sku": "d", "before": {}}, {"product_id": 1, "variation_id": 15, "sku": "d", "before": None},
        {"product_id": 1, "variation_id": None, "sku": "e", "before": {"manage_stock": True}}, {"product_id": 1, "variation_id": 0, "sku": "e", "before": {"manage_stock": True}}, {"product_id": 1, "variation_id": 16, "sku": "f"},
        {"product_id": 2, "variation_id": 17, "sku": "g", "before": {"stock_quantity": 4, "manage_stock": False}},
    ]
    path = f"{tmp_path}/snapshot.json"
    json.dump({"created_at": "now", "entries": entries}, open(path, "w"), indent=2)
    read = stored(files.read_snapshot(spark, path), "read")
    assert [r["variation_id"] for r in read.orderBy("ord").collect()] == [11, 12, 13, 14, 15, None, 0, 16, 17]
    want = {11: {"stock_status": "instock"}, 12: {"manage_stock": "parent", "stock_quantity": None, "stock_status": "in\"st"}, 17: {"manage_stock": False, "stock_quantity": 4}}
    for images in (read, files.read_snapshot(spark, text_sinks.write_snapshot(read, f"{tmp_path}/again", "shop", "now", False))):
        assert {r["variation_id"]: json.loads(r["request"]) for r in sync.rollback_requests(images).collect()} == want
    assert sync.rollback(read)[1].first().asDict() == {"total": 9, "success": 0, "failed": 0, "skipped": 9}


def test_the_log_of_a_long_run_is_whole(spark, tmp_path):
    n = 60_000
    results = spark.range(1, n + 1, numPartitions=9).selectExpr("id * 3 AS ord", f"'{sync.DONE}' AS result", "repeat('product ', 40) AS source_product", "'M' AS size", "'S' AS parent_sku", "'name' AS product_name", "1L AS product_id", "id AS variation_id", "named_struct('sku', 's', 'manage_stock', 'true', 'stock_quantity', id, 'stock_status', 'instock') AS before", "'{}' AS request", "named_struct('sku', 's', 'manage_stock', 'true', 'stock_quantity', id, 'stock_status', 'instock') AS after", "'' AS error")
    path = workbook.write_sync_log(results, f"{tmp_path}/log.xlsx")
    cells = xlsx.read_cells(spark, path, sheet=workbook.RESULTS, columns="A,G", first_row=2)
    rows = cells.groupBy("row").pivot("col", [1, 7]).agg({"value": "max"}).collect()
    assert len(rows) == n and all(int(r["1"]) == int(r["7"]) == r["row"] - 1 for r in rows)


def test_select_then_write(spark, tmp_path, shop):
    """What a selection leaves out isn't planned."""
    diffs = spark.createDataFrame([(reconcile.CHANGED, "SP5", "Brown", "S1"), (reconcile.CHANGED, "ALO", "Brown", "S2"), (reconcile.SAME, "SP5", "Brown", "S3")], "status string, source string, source_product string, parent_sku string").selectExpr("*", "'n' AS product_name")
    assert [r["parent_sku"] for r in reconcile.select_changes(diffs, [" sp5 "], "bROWN").collect()] == ["S1"]
    assert extract.UNIFIED[0] == "source"
