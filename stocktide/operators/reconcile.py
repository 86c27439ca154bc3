"""Classification of matched rows against the catalogue, the payload of an update, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import match, ordered

# Statuses, actions and notes.
CHANGED, SAME, NO_PRODUCT, NO_VARIATION, UNMATCHED, NEED_QTY = "有差异", "一致", "本店无此商品", "本店无此尺码", "未能匹配", "需人工填数量"
BY_HAND, NOTHING, NO_FIELD = "需要人工处理", "无需更新", "（无字段需要更新）"
QUANTITY, STATUS, ARROW, JOINT = "数量 ", "状态 ", " → ", "；"
NOTE_RULE_MISSING = "product_map.csv 里指定的 parent_sku「」在店里不存在，请核对货号"
NOTE_UNMATCHED = "本店没有找到对应商品。原因通常是：①本店还没上架这个品牌/款式；②名称或货号与来源不同。可在 config/product_map.csv 里补 parent_sku，或先在 WooCommerce 里建好商品再重跑 diff。"
NOTE_NO_VARIATION = "本店该商品下没有这个尺码的变体"
NOTE_NEED_QTY = "来源（货盘）标了「有货」，但本店这个变体开着「管理库存」且数量为 0。工具不会凭空猜数量：请人工在网店填上实际数量，或把 config.yaml 的 sync.mode 改成 status 后重跑。"
NOTE_SAME, NOTE_SAME_STATUS = "数量与状态都一致", "库存状态一致（本店该变体不管理具体数量）"
NOTE_STATUS_ONLY = "来源只提供「有货/缺货」（没有数量），本次只同步状态，不改动库存数字"
NOTE_UNMANAGED = "来源只提供「有货/缺货」，且本店该变体不管理具体数量"

MANUAL = (NO_PRODUCT, NO_VARIATION, UNMATCHED, NEED_QTY)
COLUMNS = ("status", "source", "category", "source_product", "size", "parent_sku", "product_name", "product_id", "variation_id", "src_qty", "store_qty", "qty_delta", "src_status", "store_status", "manages_stock", "match_method", "action", "note", "source_ref")


def _managed(mode: str) -> Column:
    return {"status": F.lit(False), "quantity": F.lit(True)}.get(mode, F.coalesce("managed", F.lit(False)))


def classify(rows: DataFrame, mode: str = "auto", update_status: bool = True, no_qty_policy: str = "status_and_zero") -> DataFrame:
    """Adds status, qty_delta, action and note.

    rows: product_id, method, variation_id, src_qty, src_status, managed, store_qty, store_status. The first condition that holds decides.
    A null `managed` counts as false.
    """
    compare, managed = _managed(mode), F.coalesce("managed", F.lit(False))
    src, store = F.col("src_qty"), F.col("store_qty")
    qty_same = ~compare | src.isNull() | (store.isNotNull() & (src == store))
    status_same = F.lit(not update_status) | F.col("src_status").eqNullSafe(F.col("store_status"))
    stocked = F.coalesce(F.col("store_status") == "instock", F.lit(False))
    need = F.lit(mode == "auto") & src.isNull() & managed & (F.col("src_status") == "instock") & ~stocked & (store.isNull() | (store == 0))
    known = F.col("product_id").isNotNull() & F.col("variation_id").isNotNull()
    status = (
        F.when(F.col("product_id").isNull() & (F.col("method") == match.RULE_MISSING), NO_PRODUCT)
        .when(F.col("product_id").isNull(), UNMATCHED)
        .when(F.col("variation_id").isNull(), NO_VARIATION)
        .when(need, NEED_QTY)
        .when(qty_same & status_same, SAME)
        .otherwise(CHANGED)
    )
    out = rows.withColumn("status", status).withColumn("qty_delta", F.when(known & ~need & compare, src - store))
    sent = payload(mode, update_status, no_qty_policy)
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    new_qty, new_status = sent["stock_quantity"], sent["stock_status"]
    parts = F.concat_ws(
        JOINT,
        F.when(new_qty.isNotNull(), F.concat(F.lit(QUANTITY), said(store), F.lit(ARROW), new_qty.cast("string"))),
        F.when(new_status.isNotNull(), F.concat(F.lit(STATUS), F.coalesce(text.status_label(F.col("store_status")), F.lit("")), F.lit(ARROW), text.status_label(new_status))),
    )
    changes = F.when(parts == "", NO_FIELD).otherwise(parts)
    action = F.when(F.col("status") == CHANGED, changes).when(F.col("status") == SAME, NOTHING).otherwise(BY_HAND)
    changed_note = F.when(src.isNull() & compare & new_qty.isNull(), NOTE_STATUS_ONLY).when(src.isNull() & ~compare, NOTE_UNMANAGED).otherwise("")
    note = F.when(F.col("status") == CHANGED, changed_note).when((F.col("status") == SAME) & compare, NOTE_SAME)
    for kind, words in ((SAME, NOTE_SAME_STATUS), (NO_PRODUCT, NOTE_RULE_MISSING), (UNMATCHED, NOTE_UNMATCHED), (NO_VARIATION, NOTE_NO_VARIATION), (NEED_QTY, NOTE_NEED_QTY)):
        note = note.when(F.col("status") == kind, words)
    return out.withColumn("action", action).withColumn("note", note)


def build_diff(rows: DataFrame, products: DataFrame, variations: DataFrame, rules: DataFrame, combos: bool = False, threshold: float = 0.86, mode: str = "auto", update_status: bool = True, no_qty_policy: str = "status_and_zero") -> DataFrame:
    """Source rows against the catalogue: one row each, with `ord` and the COLUMNS.

    rows: ord (1, 2, 3, ... in the order of files and rows), source, category, source_product, size, quantity, availability, source_ref.
    products: id, ord, sku, name. variations: id, ord, product_id, options, manage_stock (raw), stock_quantity, stock_status.
    """
    numbered = ordered.dense_occurrence_keys(rows.withColumnRenamed("source_product", "product"), "product", ["source", "category", "product"], "ord")
    ruled = match.rule_lookup(numbered, rules)
    matched = match.match_products(numbered.select("ord", "source", "category", "product", "occurrence"), products, rules, combos, threshold)
    found = match.find_variation(ruled.join(matched, "ord"), variations)
    catalogue = products.select(F.col("id").alias("product_id"), F.coalesce("sku", F.lit("")).alias("catalogue_sku"), F.coalesce("name", F.lit("")).alias("product_name"))
    stock = variations.select("product_id", F.col("id").alias("variation_id"), text.truthy(F.col("manage_stock")).alias("managed"), F.col("stock_quantity").alias("store_qty"), F.coalesce("stock_status", F.lit("")).alias("store_status"))
    joined = found.join(catalogue, "product_id", "left").join(stock, ["product_id", "variation_id"], "left")
    ready = joined.withColumnsRenamed({"quantity": "src_qty", "availability": "src_status"})
    out = classify(ready, mode, update_status, no_qty_policy)
    named = out.select("ord", *[F.col({"source_product": "product", "parent_sku": "catalogue_sku", "match_method": "method", "manages_stock": "managed"}.get(c, c)).alias(c) for c in COLUMNS])
    return named.fillna({"parent_sku": "", "product_name": "", "store_status": "", "manages_stock": False})


def payload(mode: str = "auto", update_status: bool = True, no_qty_policy: str = "status_and_zero") -> Column:
    """Sparse update of a row as a struct; fields that stay as they are are null."""
    managed = _managed(mode)
    quantity = F.coalesce(F.col("src_qty"), F.when(F.lit(no_qty_policy == "status_and_zero") & (F.col("src_status") == "outofstock"), F.lit(0).cast("bigint")))
    return F.struct(F.when(managed, F.lit(True)).alias("manage_stock"), F.when(managed, quantity).alias("stock_quantity"), F.when(F.lit(update_status), F.col("src_status")).alias("stock_status"))


def summarize(diffs: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(n) for n, s in (("changed", CHANGED), ("same", SAME), ("no_product", NO_PRODUCT), ("no_variation", NO_VARIATION), ("unmatched", UNMATCHED), ("need_qty", NEED_QTY))]
    return diffs.agg(F.count("*").alias("total"), *counts, F.count_distinct("product_id").alias("products"), F.count_distinct(F.when(F.col("status") == CHANGED, F.col("product_id"))).alias("changed_products"))


def select_changes(diffs: DataFrame, sources: list[str] | None = None, needle: str = "") -> DataFrame:
    out = diffs.where(F.col("status") == CHANGED)
    if sources is not None:
        out = out.where(F.lower("source").isin([s.strip().lower() for s in sources if s.strip()]))
    if needle.strip():
        out = out.where(F.lower(F.concat_ws(" ", "parent_sku", "product_name", "source_product" if "source_product" in diffs.columns else "product")).contains(needle.strip().lower()))
    return out


def collapse_updates(changes: DataFrame) -> DataFrame:
    """One update per variation, field by field the last value that a row sets: what one write after another would leave."""
    fields = [F.max_by(f"payload.{f}", F.when(F.col(f"payload.{f}").isNotNull(), F.col("ord"))).alias(f) for f in ("manage_stock", "stock_quantity", "stock_status")]
    return changes.groupBy("product_id", "variation_id").agg(F.count("*").alias("writes"), *fields)


def transitions(diffs: DataFrame, keys: list[str], item: Column, note: str, separator: str = "、") -> DataFrame:
    """Per key: how many rows, their items in order, and the first note."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]), separator)
    return diffs.groupBy(*keys).agg(F.count("*").alias("n"), listed.alias("items"), F.min_by(note, "ord").alias("first_note"))
