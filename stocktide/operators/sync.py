"""Guarded write-back: what is to be written, the values before, one write per variation, and the way back.

A run goes by its id in a `Ledger`, a folder that outlives sessions. The plan and the before-images of all that it would write are there,
written to their end, before the first send; what was sent is in the ledger's attempts. So a run that broke off goes on from there
(`resume`), and can be taken back (`undo`), in another session too. Nothing is sent unless that is confirmed, and after writes the kept
catalogue is forgotten. Writes go out once per variation, with what one write after another would leave. A `send` is a
function (product_id, variation_id, payload as a dict) -> the variation as it is afterwards (a dict); an exception is that
variation's failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import reconcile
from stocktide.operators.match import met
from stocktide.sinks import updates
from stocktide.storage import complete, fresh, remove

# How a write ended.
DONE, FAILED, SKIPPED, REHEARSED = "成功", "失败", "跳过", "演练（未提交）"
NO_VARIATION = "找不到变体"
LOG_COLUMNS = ("序号", "结果", "来源商品", "尺码", "本店 SKU", "本店商品", "变体 ID", "更新前", "更新请求", "更新后", "错误信息")
STOCK_FIELDS = ("manage_stock", "stock_quantity", "stock_status")
IMAGE = updates.IMAGE
VARIATION = ["product_id", "variation_id"]
# What sends and results take of a plan; its other columns (notes and actions of the diff, texts of some hundred characters) are never read.
PLAN = ["ord", "source_product", "size", "parent_sku", "product_name", *VARIATION, "before", "payload"]


def payload_text(payload: Column) -> Column:
    """The sparse payload as JSON text."""
    parts = F.concat_ws(
        ", ",
        F.when(payload["manage_stock"].isNotNull(), F.concat(F.lit('"manage_stock": '), payload["manage_stock"].cast("string"))),
        F.when(payload["stock_quantity"].isNotNull(), F.concat(F.lit('"stock_quantity": '), payload["stock_quantity"].cast("string"))),
        F.when(payload["stock_status"].isNotNull(), F.concat(F.lit('"stock_status": "'), payload["stock_status"], F.lit('"'))),
    )
    return F.concat(F.lit("{"), parts, F.lit("}"))


def image_text(image: Column) -> Column:
    return F.when(image.isNull(), "").otherwise(text.stock_text(image["stock_quantity"], image["stock_status"], image["manage_stock"]))


def planned(changes: DataFrame, variations: DataFrame, mode: str = "auto", update_status: bool = True, no_qty_policy: str = "status_and_zero") -> DataFrame:
    """Changes (rows of a diff) with `before` (null: the variation is gone) and `payload`."""
    before = variations.select("product_id", F.col("id").alias("variation_id"), F.struct("sku", F.col("manage_stock").cast("string").alias("manage_stock"), "stock_quantity", "stock_status").alias("before"))
    joined = met(changes, before, VARIATION, "left").withColumn("managed", text.truthy(F.col("before.manage_stock")))
    return joined.withColumn("payload", reconcile.payload(mode, update_status, no_qty_policy)).drop("managed")


def _json(value: Column) -> Column:
    """A text as JSON, quoted; null as null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def snapshot(plan: DataFrame) -> DataFrame:
    """Before-images of all that a plan would write, one per variation: `before` maps each field to its value in JSON."""
    b, managed = F.col("before"), F.col("before.manage_stock")
    values = (_json(b["sku"]), F.when(managed.isin("true", "false"), managed).otherwise(_json(managed)), F.coalesce(b["stock_quantity"].cast("string"), F.lit("null")), _json(b["stock_status"]))
    image = F.create_map(*[x for k, v in zip(("sku", *STOCK_FIELDS), values) for x in (F.lit(k), v)])
    first = F.min_by(F.struct(F.col("parent_sku").alias("sku"), b.alias("before")), "ord")
    found = plan.where("before is not null").groupBy(*VARIATION).agg(first.alias("s"))
    return found.select(*VARIATION, "s.sku", F.col("s.before").alias("before")).select(*VARIATION, "sku", image.alias("before"))


def requests(plan: DataFrame) -> DataFrame:
    """One request per variation: what its rows, one after another, would leave."""
    merged = reconcile.collapse_updates(plan.where("before is not null"))
    return merged.select(*VARIATION, payload_text(F.struct(*STOCK_FIELDS)).alias("request"))


def _results(plan: DataFrame, sent: DataFrame | None) -> DataFrame:
    """Every row of a plan and how it ended; without `sent` it is a rehearsal."""
    nth = plan.select("ord", "source_product", "size", "parent_sku", "product_name", *VARIATION, "before", payload_text(F.col("payload")).alias("request"))
    if sent is None:
        done = nth.withColumns({"ok": F.lit(None).cast("boolean"), "after": F.lit(None).cast(IMAGE), "error": F.lit("")})
    else:
        done = met(nth, sent.select(*VARIATION, "ok", "after", "error"), VARIATION, "left")
    result = F.when(F.col("before").isNull(), SKIPPED).when(F.lit(sent is None), REHEARSED).when(F.col("ok"), DONE).otherwise(FAILED)
    return done.withColumn("result", result).withColumn("error", F.when(F.col("before").isNull(), NO_VARIATION).otherwise(F.coalesce("error", F.lit(""))))


def may_write(confirmed: bool = False, answer: str | None = None) -> bool:
    """Nothing is written unless it is confirmed by a flag or by the typed word."""
    return confirmed or (answer or "").strip().upper() == "YES"


@dataclass(frozen=True)
class Ledger:
    """Runs in a folder: plan, images, attempts and results of each. A table counts only when it was written to its end."""

    spark: SparkSession
    folder: str

    def path(self, kind: str, run_id: str) -> str:
        return f"{self.folder.rstrip('/')}/{kind}/run_id={run_id}"

    def put(self, kind: str, run_id: str, df: DataFrame) -> DataFrame:
        path = self.path(kind, run_id)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, kind: str, run_id: str) -> DataFrame:
        if not complete(self.spark, self.path(kind, run_id)):
            raise LookupError(f"run {run_id} has no {kind}")
        return self.spark.read.parquet(self.path(kind, run_id))

    def begin(self, run_id: str, plan: DataFrame) -> DataFrame:
        """The plan, stored with its images. A run that has its images is never planned anew: values read then may be its own."""
        if complete(self.spark, self.path("images", run_id)):
            raise ValueError(f"run {run_id} has begun already: resume it or take it back")
        kept = self.put("plan", run_id, plan.select(*PLAN))
        self.put("images", run_id, snapshot(kept))
        return kept

    def entries(self, run_id: str) -> DataFrame:
        """Images of what a run may have changed: all that it announced, but for sends that failed. Of a rehearsal, all."""
        images = self.get("images", run_id)
        announced = updates.announced(self.spark, self.path("attempts", run_id))
        if announced.isEmpty():
            return images
        failed = updates.outcomes(self.spark, self.path("attempts", run_id)).where("not ok")
        return met(met(images, announced, VARIATION, "left_semi"), failed, VARIATION, "left_anti")


def write_back(ledger: Ledger, run_id: str, plan: DataFrame, send: updates.Send | None = None, confirmed: bool = False, answer: str | None = None, forget: Callable[[], None] | None = None, **how) -> DataFrame:
    """Results of a new run. Unless it is confirmed it is a rehearsal: plan, images and results are kept, and nothing is sent.

    `forget` drops the kept catalogue once anything was written. how: writers, chunk and read, as `updates.deliver` takes them.
    """
    kept = ledger.begin(run_id, plan)
    if send is None or not may_write(confirmed, answer):
        return ledger.put("results", run_id, _results(kept, None))
    return resume(ledger, run_id, send, confirmed, answer, forget, **how)


def resume(ledger: Ledger, run_id: str, send: updates.Send, confirmed: bool = False, answer: str | None = None, forget: Callable[[], None] | None = None, **how) -> DataFrame:
    """Results of a run that has begun: what has no outcome yet is sent, the rest stays as it ended."""
    plan, folder = ledger.get("plan", run_id), ledger.path("attempts", run_id)
    ledger.get("images", run_id)  # without them there is no way back, and nothing is sent
    if not may_write(confirmed, answer):
        return _results(plan, None)
    left = met(requests(plan), updates.outcomes(ledger.spark, folder), VARIATION, "left_anti")
    results = ledger.put("results", run_id, _results(plan, updates.deliver(left, send, folder, **how)))
    if forget is not None and not results.where(F.col("result") == DONE).isEmpty():
        forget()
    return results


def undo(ledger: Ledger, run_id: str, send: updates.Send | None = None, confirmed: bool = False, answer: str | None = None, forget: Callable[[], None] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(results, totals) of taking a run back; a session that knows only its id is enough."""
    write = send is not None and may_write(confirmed, answer)
    results, totals = rollback(ledger.entries(run_id), send if write else None, folder=ledger.path("attempts", f"{run_id}-undone"), **how)
    results = ledger.put("results", f"{run_id}-undone", results)
    if write and forget is not None and not results.where(F.col("result") == DONE).isEmpty():
        forget()
    return results, totals


def apply_updates(plan: DataFrame, send: updates.Send | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(results, snapshot) of a plan within one application, whose tables go with it. Without `send` it is a rehearsal. Plan and snapshot
    are stored first; of the snapshot, `kept_entries` tells what the results leave."""
    ledger, run_id = Ledger(plan.sparkSession, fresh(plan.sparkSession, "ledger")), "run"
    results = write_back(ledger, run_id, plan, send, confirmed=True, **how)
    return results, ledger.get("images", run_id)


def kept_entries(images: DataFrame, results: DataFrame) -> DataFrame:
    """Entries of a snapshot whose write succeeded or was rehearsed."""
    good = results.where(F.col("result").isin(DONE, REHEARSED)).select(*VARIATION).distinct()
    return met(images, good, VARIATION, "left_semi")


def totals(results: DataFrame) -> DataFrame:
    skipped = F.count_if(F.col("result").isin(SKIPPED, REHEARSED))
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("result") == DONE).alias("success"), F.count_if(F.col("result") == FAILED).alias("failed"), skipped.alias("skipped"))


def by_product(results: DataFrame, arrow: str = "→") -> DataFrame:
    """Writes of each product, and what they changed, in order."""
    item = F.concat("size", F.lit(": "), image_text(F.col("before")), F.lit(f" {arrow} "), F.when(F.col("before").isNull(), "").otherwise(F.col("request")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), "；")
    return results.groupBy("parent_sku", "product_name").agg(F.count("*").alias("n"), F.count_if(F.col("result") == DONE).alias("ok"), F.count_if(F.col("result") == FAILED).alias("fail"), listed.alias("changes"))


def log_rows(results: DataFrame, numbered: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The sync log as it is shown; `numbered` gives `ord` as 1, 2, 3, ..."""
    rows = numbered(results.withColumnRenamed("ord", "_ord"), ["_ord"])
    values = (F.col("ord"), F.col("result"), F.col("source_product"), F.col("size"), F.col("parent_sku"), F.col("product_name"), F.col("variation_id"), image_text(F.col("before")), F.when(F.col("before").isNull(), "").otherwise(F.col("request")), image_text(F.col("after")), F.col("error"))
    return rows.select(*[v.alias(name) for v, name in zip(values, LOG_COLUMNS)])


def rollback_requests(images: DataFrame) -> DataFrame:
    """Updates that put the stock of every entry back: the fields that its image has, null ones too. Entries without a
    variation, and images without any of the fields, give none."""
    field = lambda k: F.when(F.map_contains_key("before", F.lit(k)), F.concat(F.lit(f'"{k}": '), F.col("before")[k]))
    asked = images.where("variation_id is not null and variation_id <> 0 and before is not null")
    asked = asked.select(*VARIATION, "sku", F.concat_ws(", ", *map(field, STOCK_FIELDS)).alias("fields")).where("fields <> ''")
    return asked.select(*VARIATION, "sku", F.concat(F.lit("{"), "fields", F.lit("}")).alias("request"))


def rollback(images: DataFrame, send: updates.Send | None = None, folder: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(results, totals) of a rollback; what isn't written counts as skipped. `folder` holds the attempts."""
    asked = rollback_requests(images)
    if send is None:
        results = asked.withColumn("result", F.lit(REHEARSED)).withColumn("error", F.lit(""))
    else:
        folder = folder or fresh(images.sparkSession, "attempts")
        done = updates.outcomes(images.sparkSession, folder)
        sent = updates.deliver(met(asked, done, VARIATION, "left_anti"), send, folder, **how)
        results = met(asked, sent.select(*VARIATION, "ok", "error"), VARIATION).withColumn("result", F.when(F.col("ok"), DONE).otherwise(FAILED)).drop("ok")
    counts = results.agg(F.count_if(F.col("result") == DONE).alias("success"), F.count_if(F.col("result") == FAILED).alias("failed"))
    whole = images.agg(F.count("*").alias("total")).crossJoin(counts)  # two single rows
    return results, whole.withColumn("skipped", F.col("total") - F.col("success") - F.col("failed"))


def drop_run(ledger: Ledger, run_id: str) -> None:
    """Remove all that a ledger holds of a run, after which it can't be taken back."""
    for kind in ("plan", "images", "attempts", "results"):
        remove(ledger.spark, ledger.path(kind, run_id))
