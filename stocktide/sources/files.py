"""Sources other than workbooks: mapping rules, unified files, catalogues, snapshots, baselines, and the configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import extract
from stocktide.sources import xlsx
from stocktide.storage import complete, exists

RULES = "source string, category string, product string, parent_sku string, size_map string, note string"
PRODUCTS = "id bigint, ord bigint, sku string, name string, type string"
VARIATIONS = "product_id bigint, ord bigint, id bigint, sku string, options array<string>, manage_stock string, stock_quantity bigint, stock_status string"
CATALOGUE = "base_url string, products array<struct<id:bigint,sku:string,name:string,type:string>>, variations map<string,array<struct<id:bigint,sku:string,attributes:array<struct<option:string>>,manage_stock:string,stock_quantity:bigint,stock_status:string>>>"
# Fixed values.
RULE_HEADER = ("source", "category", "source_product", "parent_sku", "size_map", "note")
UNIFIED_SUFFIX = "_统一库存.xlsx"
COMBINED = "全部库存_合并.xlsx"
DEFAULTS = {
    "store": {"base_url": "", "consumer_key": "", "consumer_secret": "", "verify_ssl": True, "timeout": 60, "per_page": 100, "api_version": "wc/v3"},
    "paths": {"output_dir": "output", "mapping_file": "config/product_map.csv"},
    "sync": {"mode": "auto", "update_status": True, "no_qty_policy": "status_and_zero"},
    "options": {"fuzzy_threshold": 0.86, "include_combo_skus": False},
    "sources": [],
}
KEYS_FROM = {"consumer_key": "SHOP_CONSUMER_KEY", "consumer_secret": "SHOP_CONSUMER_SECRET"}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rules of a CSV file with a header (a mark of byte order is skipped), with `ord` of the file; a missing file has none.

    Columns are found by their names. A quoted field may hold line breaks, so a file is read in one piece and its rows keep their order.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], RULES + ", ord bigint")
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    named = {c.lstrip("﻿").strip(): c for c in raw.columns}
    tidy = lambda c: text.strip(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))) if c in named else F.lit("")
    rows = raw.select(*[tidy(c).alias("product" if c == "source_product" else c) for c in RULE_HEADER], F.monotonically_increasing_id().alias("ord"))
    return rows.withColumn("category", F.when(F.col("category") == "", "*").otherwise(F.col("category"))).where("product <> ''")


def read_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Unified workbooks of a folder, in the order of their names, as they come back: see `extract.unified_again`. With file and row."""
    path = f"{folder}/*{UNIFIED_SUFFIX}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no unified workbook in {folder}")
    cells = xlsx.read_cells(spark, path, first_sheet=True).where(F.col("file") != COMBINED)
    header = cells.where("row = 1").select("file", "col", F.col("value").alias("name"))
    values = cells.where("row > 1").join(header, ["file", "col"])
    rows = values.groupBy("file", "row").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in extract.UNIFIED])
    return extract.unified_again(rows.withColumn("quantity", F.col("quantity").try_cast("double").try_cast("bigint")))


def read_catalogue(spark: SparkSession, path: str, base_url: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(products, variations) of a catalogue kept as JSON; None if it is of another shop or has no products."""
    if not exists(spark, path):
        return None
    whole = spark.read.json(path, schema=CATALOGUE, multiLine=True)
    if whole.where((F.size("products") > 0) & (F.lit(base_url is None) | F.col("base_url").eqNullSafe(F.lit(base_url)))).isEmpty():
        return None
    products = whole.select(F.posexplode("products").alias("ord", "p")).select("p.id", F.col("ord").cast("bigint"), "p.sku", "p.name", "p.type")
    variations = whole.select(F.explode("variations").alias("product_id", "vs")).select(F.col("product_id").cast("bigint"), F.posexplode("vs").alias("ord", "v"))
    return products, shaped_variations(variations.select("product_id", F.col("ord").cast("bigint"), "v.*"), products)


def shaped_variations(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Variations as the operators take them; only products of type variable have any."""
    options = F.transform(F.coalesce("attributes", F.array().cast("array<struct<option:string>>")), lambda a: a["option"])
    shaped = raw.select("product_id", "ord", "id", "sku", options.alias("options"), "manage_stock", "stock_quantity", "stock_status")
    return shaped.join(products.where("type = 'variable'").select(F.col("id").alias("product_id")), "product_id", "left_semi")


def catalogue_totals(products: DataFrame, variations: DataFrame) -> DataFrame:
    """One row: products, those that can have variations, and variations."""
    counts = products.agg(F.count("*").alias("products"), F.count_if(F.col("type") == "variable").alias("variable_products"))
    return counts.crossJoin(variations.agg(F.count("*").alias("variations")))  # two single rows


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a rollback snapshot in their order, written as JSON lines or as one document with `entries`. `before` maps the fields
    that an entry has to their values in JSON; it is null where there is no image."""
    lines = complete(spark, path)
    entry = "product_id bigint, variation_id bigint, sku string, before variant, ord bigint"
    if lines:
        found = spark.read.schema(entry).json(path)
    else:
        whole = spark.read.schema("entries array<struct<product_id:bigint,variation_id:bigint,sku:string,before:variant>>").json(path, multiLine=True)
        found = whole.select(F.posexplode("entries").alias("ord", "e")).select("e.*", F.col("ord").cast("bigint").alias("ord"))
    fields = F.from_json(F.to_json("before"), "map<string,variant>")
    before = F.transform_values(fields, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    return found.select("ord", "product_id", "variation_id", "sku", F.when(F.schema_of_variant("before").startswith("OBJECT"), before).alias("before"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(source, n_rows, products, total_rows) that a run is held against."""
    whole = spark.read.json(path, schema="sources map<string,struct<rows:bigint,products:bigint>>, total_rows bigint", multiLine=True)
    return whole.select(F.explode("sources").alias("source", "s"), "total_rows").select("source", F.col("s.rows").alias("n_rows"), "s.products", "total_rows")


def configuration(path: str | None = None, given: Mapping | None = None, environment: Mapping[str, str] = os.environ) -> dict:
    """Settings with their defaults; keys of the shop may come from the environment. The file is JSON, or YAML where that can be read."""
    if path:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        try:
            given = json.loads(raw)
        except json.JSONDecodeError:
            import yaml  # optional: only YAML files need it

            given = yaml.safe_load(raw)
    out = {part: {**default, **((given or {}).get(part) or {})} if isinstance(default, dict) else (given or {}).get(part, default) for part, default in DEFAULTS.items()}
    for key, variable in KEYS_FROM.items():
        out["store"][key] = environment.get(variable) or out["store"][key]
    return out


def read_source(spark: SparkSession, source: Mapping) -> DataFrame:
    """Unified rows of one configured source, with file and row."""
    if not exists(spark, source["file"]):
        raise FileNotFoundError(f"no source file: {source['file']}")
    adapter, options = source.get("adapter", "excel_table"), source.get("options") or {}
    if adapter == "pdf_pallet":
        from stocktide.operators import pallet

        read = lambda name: spark.read.parquet(f"{source['file']}/{name}.parquet")
        strips = exists(spark, f"{source['file']}/strips.parquet")
        marks = {"marks": pallet.mark_index(read("strips"))} if strips else {"mark_cells": read("mark_cells")}
        return pallet.inventory(read("words"), read("rects"), source=source["id"], file=source["file"].rstrip("/").rsplit("/", 1)[-1], **marks, **options)
    if adapter != "excel_table":
        raise ValueError(f"unknown adapter: {adapter}")
    sheet = extract.Sheet(source["id"], options.get("product_column", "B"), options.get("size_column", "C"), options.get("quantity_column"), int(options.get("start_row", 1)), options.get("stop_row") and int(options["stop_row"]), options.get("sheet"))
    # A merged range gives its first cell's value to cells in the range of rows, even if it starts above them.
    columns = ",".join(x for x in (sheet.product, sheet.size, sheet.quantity) if x)
    first = sheet.sheet is None
    merges = xlsx.read_merges(spark, source["file"], sheet.sheet, first)
    leftmost = merges.agg(F.max(F.col("max_col") - F.col("min_col"))).first()[0] or 0
    cells = xlsx.read_cells(spark, source["file"], sheet.sheet, None if leftmost else columns, last_row=sheet.stop, first_sheet=first)
    return extract.table_rows(cells, merges, sheet)
