"""What reports show of a diff: display columns, highlights, and groups by product. All are DataFrames; `sinks` write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import match, reconcile

# Headers.
DIFF_HEADER = ("状态", "来源", "分区/品类", "来源商品", "来源尺码", "本店 SKU", "本店商品", "变体 ID", "来源数量", "在线数量", "数量差", "来源库存状态", "在线库存状态", "本店是否管理库存", "匹配方式", "将要执行的更新", "备注")
TODO_HEADER = ("来源", "分区/品类", "来源商品/货号", "尺码范围", "尺码数", "近似货号建议（本店）", "建议商品名", "处理建议")
SUMMARY_LABELS = (("total", "比对总行数"), ("changed", "有差异（待更新）"), ("same", "一致（无需更新）"), ("no_product", "本店无此商品"), ("no_variation", "本店无此尺码"), ("unmatched", "未能匹配"), ("need_qty", "需人工填数量"), ("products", "涉及商品数"), ("changed_products", "涉及需要更新的商品数"))
COMBINED = "（组合款）"
NO_SUGGESTION_FOR = "ALO"
PRODUCT = ("source", "category", "source_product", "parent_sku", "product_name")


def present(diffs: DataFrame) -> DataFrame:
    """The 17 display columns, with `ord`, the status and whether quantity and status cells are to be marked."""
    c = F.col
    values = (
        c("status"), c("source"), c("category"), c("source_product"), c("size"), c("parent_sku"), c("product_name"), F.when(c("variation_id") != 0, c("variation_id").cast("string")).otherwise(""),
        text.shown(c("src_qty")), text.shown(c("store_qty")), text.shown(c("qty_delta")), text.status_label(c("src_status")), text.status_label(c("store_status")), text.yes_no(c("manages_stock")), c("match_method"), c("action"), c("note"),
    )
    changed = c("status") == reconcile.CHANGED
    marks = [(changed & (F.coalesce("qty_delta", F.lit(0)) != 0)).alias("mark_quantity"), (changed & ~c("src_status").eqNullSafe(c("store_status"))).alias("mark_status")]
    return diffs.select("ord", c("status").alias("status"), *marks, *[v.alias(name) for v, name in zip(values, DIFF_HEADER)])


def parts(diffs: DataFrame) -> dict[str, DataFrame]:
    """Changed, unchanged and manual rows."""
    kind = F.col("status")
    return {"changed": diffs.where(kind == reconcile.CHANGED), "same": diffs.where(kind == reconcile.SAME), "manual": diffs.where(kind.isin(*reconcile.MANUAL))}


def todo(diffs: DataFrame, products: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Manual rows by product: sizes in order, how many, the first note, and the catalogue's nearest identifier.

    Products named like NO_SUGGESTION_FOR get no suggestion; `ignore_case` tells whether that holds for any case.
    """
    keys = ["source", "category", "source_product"]
    grouped = reconcile.transitions(parts(diffs)["manual"], keys, F.col("size"), "note").join(parts(diffs)["manual"].groupBy(*keys).agg(F.min("ord").alias("ord")), keys)
    base = text.before_number_sign(F.col("source_product"))
    named = grouped.withColumn("key", base)
    tested = F.upper("key") if ignore_case else F.col("key")
    wanted = named.where((F.col("key") != "") & ~tested.startswith(NO_SUGGESTION_FOR)).select("key")
    near = match.nearest_sku(wanted, products, limit=1).join(products.select("id", F.coalesce("name", F.lit("")).alias("near_name")), "id")
    near = near.select("key", F.concat(F.coalesce("sku", F.lit("")), F.when(F.col("combo"), COMBINED).otherwise("")).alias("near_sku"), "near_name")
    out = named.join(near, "key", "left").drop("key")
    return out.select("ord", *keys, F.col("items").alias("sizes"), F.col("n").alias("n_sizes"), F.coalesce("near_sku", F.lit("")).alias("near_sku"), F.coalesce("near_name", F.lit("")).alias("near_name"), F.col("first_note").alias("note"))


def first_rows(rows: DataFrame) -> DataFrame:
    """PRODUCT and the place of its first row."""
    return rows.groupBy(*PRODUCT).agg(F.min("ord").alias("ord"))


def changes_by_product(diffs: DataFrame) -> DataFrame:
    """Changed rows by product: how each size's quantity (else status) moves, and the first action."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    some = F.col("src_qty").isNotNull() | F.col("store_qty").isNotNull()
    by_status = F.concat("size", F.lit(": "), text.status_label(F.col("store_status")), F.lit("→"), text.status_label(F.col("src_status")))
    item = F.when(some, F.concat("size", F.lit(": "), number("store_qty"), F.lit("→"), number("src_qty"))).otherwise(by_status)
    return reconcile.transitions(parts(diffs)["changed"], list(PRODUCT), item, "action")


def summary_rows(diffs: DataFrame) -> DataFrame:
    """The summary sheet: a label and a figure for each line, in order."""
    counts = reconcile.summarize(diffs)
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), F.col(name).cast("bigint").alias("figure")) for i, (name, label) in enumerate(SUMMARY_LABELS)])
    return counts.select(F.explode(lines).alias("l")).select("l.*")


def preview(diffs: DataFrame, limit: int = 25, groups: int = 12) -> tuple[DataFrame, DataFrame]:
    """The first changed rows and the first products with manual rows, in order: what a console shows."""
    manual = parts(diffs)["manual"].groupBy("source", "category", "source_product").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return parts(diffs)["changed"].orderBy("ord").limit(limit), manual.orderBy("ord").limit(groups)


def preview_counts(diffs: DataFrame) -> DataFrame:
    """One row: changed, same and manual rows, and products that manual rows are of."""
    kind = F.col("status")
    product = F.struct("source", "category", "source_product")
    return diffs.agg(F.count_if(kind == reconcile.CHANGED).alias("changed"), F.count_if(kind == reconcile.SAME).alias("same"), F.count_if(kind.isin(*reconcile.MANUAL)).alias("manual"), F.count_distinct(F.when(kind.isin(*reconcile.MANUAL), product)).alias("groups"))
