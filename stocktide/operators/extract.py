"""Source sheets to unified inventory rows, and checks of what was read.

Sheets come as cells (file, sheet, row, col, value, kind) and merged ranges (file, sheet, min_row, max_row, min_col, max_col), as
`sources.xlsx` reads them; kind is "n" for numbers, "b" for booleans, "d" for dates, "s" for text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import ordered
from stocktide.storage import stored

UNIFIED = ("source", "category", "source_product", "size", "quantity", "availability", "source_ref")
PLACE_BITS = 33  # of Spark's increasing ids: the place within a partition


@dataclass(frozen=True)
class Sheet:
    """Where a source's columns stand; `quantity` may be missing, rows outside of start..stop are left out."""

    source: str
    product: str = "B"
    size: str = "C"
    quantity: str | None = None
    start: int = 1
    stop: int | None = None
    sheet: str | None = None


def merged_pieces(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(file, sheet, col, lo, hi, value, kind): which rows of a column show the value of which merged range, each row in one piece at most.

    Of ranges that meet, the one that starts later shows. In a column it ends the one before, unless the one before goes on after it: only such
    columns are opened into their places.
    """
    where, column = ["file", "sheet"], ["file", "sheet", "col"]
    top = merges.join(cells.select(*where, F.col("row").alias("min_row"), F.col("col").alias("min_col"), "value", "kind"), [*where, "min_row", "min_col"]).where("value is not null")
    w = Window.partitionBy(*column).orderBy("min_row", "min_col")
    opened = top.withColumn("col", F.explode(F.sequence("min_col", "max_col"))).withColumns({"_reach": F.max("max_row").over(w), "_next": F.lead("min_row").over(w)})
    opened = opened.withColumn("_within", F.max(F.col("_reach") > F.col("max_row")).over(Window.partitionBy(*column)))
    plain = opened.where("not _within").select(*column, F.col("min_row").alias("lo"), F.least("max_row", F.col("_next") - 1).alias("hi"), "value", "kind").where("lo <= hi")
    places = opened.where("_within").withColumn("row", F.explode(F.sequence("min_row", "max_row"))).groupBy(*column, "row").agg(F.max_by(F.struct("value", "kind"), F.struct("min_row", "min_col")).alias("v"))
    return plain.unionByName(places.select(*column, F.col("row").alias("lo"), F.col("row").alias("hi"), "v.*"))


def merged_values(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """(file, sheet, row, col, value, kind) of every place of a merged range that has a value at its top left."""
    return merged_pieces(cells, merges).select("file", "sheet", F.explode(F.sequence("lo", "hi")).alias("row"), "col", "value", "kind")


def read_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells as a reader sees them: the value of their merged range first, else their own.

    Cells and pieces of ranges meet in the order of their column; places are made from pieces after that, so they are never shuffled.
    """
    fields = ["file", "sheet", "col", "lo", "hi", "value", "kind"]
    own = cells.select("file", "sheet", "col", F.col("row").alias("lo"), F.lit(None).cast("int").alias("hi"), "value", "kind")
    w = Window.partitionBy("file", "sheet", "col").orderBy("lo", F.col("hi").isNull())
    both = own.select(*fields).unionByName(merged_pieces(cells, merges).select(*fields))
    dealt = both.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "sheet", "col")  # few rows, many places
    seen = dealt.withColumn("_upto", F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shown = seen.where(F.col("hi").isNotNull() | F.col("_upto").isNull() | (F.col("_upto") < F.col("lo")))
    return shown.select("file", "sheet", F.explode(F.sequence("lo", F.coalesce("hi", "lo"))).alias("row"), "col", "value", "kind")


def table_rows(cells: DataFrame, merges: DataFrame, sheet: Sheet) -> DataFrame:
    """Unified rows of one source, with `file` and `row`: product names go on until the next one, rows without a size are left out, and of
    neighbouring rows of the same product and size the first stays."""
    if sheet.sheet is not None:
        cells, merges = cells.where(F.col("sheet") == sheet.sheet), merges.where(F.col("sheet") == sheet.sheet)
    numbers = {name: text.column_number(letter) for name, letter in (("product", sheet.product), ("size", sheet.size), ("quantity", sheet.quantity)) if letter}
    seen = read_cells(cells, merges).where(F.col("col").isin(*numbers.values()) & (F.col("row") >= sheet.start))
    if sheet.stop is not None:
        seen = seen.where(F.col("row") <= sheet.stop)
    pick = [F.max(F.when(F.col("col") == n, F.struct("value", "kind"))).alias(name) for name, n in numbers.items()]
    rows = seen.groupBy("file", "sheet", "row").agg(*pick)
    if "quantity" not in numbers:
        rows = rows.withColumn("quantity", F.lit(None).cast("struct<value:string,kind:string>"))
    rows = rows.withColumn("_raw", F.col("product.value")).withColumn("_name", F.when(F.coalesce("_raw", F.lit("")) != "", text.cell_text(F.col("product.value"), F.col("product.kind"))))
    w = Window.partitionBy("file", "sheet").orderBy("row")
    rows = rows.withColumn("source_product", F.coalesce(F.last("_name", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    rows = rows.withColumn("size", text.normalize_size(text.cell_text(F.col("size.value"), F.col("size.kind")))).where("size <> ''")
    rows = ordered.drop_consecutive(rows, ["source_product", "size"], ["file", "sheet"], "row")
    said = text.cell_text(F.col("quantity.value"), F.col("quantity.kind"))
    quantity = text.cell_int(F.col("quantity.value"), F.col("quantity.kind"))
    availability = cell_availability(quantity, said, "quantity" in numbers)
    ref = F.concat("file", F.lit("!"), "sheet", F.lit("!R"), F.col("row").cast("string"))
    return rows.select("file", "row", F.lit(sheet.source).alias("source"), F.lit("").alias("category"), "source_product", "size", quantity.alias("quantity"), availability.alias("availability"), ref.alias("source_ref"))


def cell_availability(quantity: Column, said: Column, has_quantity: bool) -> Column:
    """A number decides by its sign; any other text is in stock, an empty cell isn't; without a quantity column all is in stock."""
    if not has_quantity:
        return F.lit("instock")
    return F.when(quantity.isNotNull(), text.availability(quantity)).when(said != "", "instock").otherwise("outofstock")


def union_sources(parts: list[DataFrame], only: list[str] | None = None) -> DataFrame:
    """All rows of the sources, one below the other; `only` names the sources to keep."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("source").isin(*only)) if only else out


def unified_again(rows: DataFrame) -> DataFrame:
    """Unified rows as they come back from a file: without product and size they are left out, and a quantity of 0 is no quantity."""
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    kept = rows.where((shown("source_product") != "") | (shown("size") != ""))
    blank = {c: shown(c) for c in ("source", "category", "source_product", "size", "source_ref")}
    availability = F.when(shown("availability") == "", "instock").otherwise(F.col("availability"))
    return kept.withColumns({**blank, "quantity": F.nullif("quantity", F.lit(0)), "availability": availability})


def numbered(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """`ord`: 1, 2, 3, ... in the given order, however many rows and wherever its ranges are cut.

    Rows are written once, range by range and in order, each with its range and its place there as a plain column; what reads them again
    (sizes of the ranges, the rows themselves) can't come to other ranges. A row per range tells how many rows lie before it.
    Rows of equal order follow their contents, then their places in `rows`, so that a frequent value is cut into ranges, too.
    """
    tie = [F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.monotonically_increasing_id()]
    tied = rows.withColumns({"_tie": tie[0], "_row": tie[1]})
    keys = [*order, "_tie", "_row"]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_row").withColumn("_at", F.monotonically_increasing_id())
    written = stored(placed, "ranges").withColumn("_range", F.shiftright("_at", PLACE_BITS))
    sizes = written.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each range, of which there are as many as shuffle partitions
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return written.join(F.broadcast(before), "_range").withColumn("ord", F.col("_before") + place + 1).drop("_at", "_range", "_before")


def source_stats(rows: DataFrame, product: str = "source_product") -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct(product).alias("products"))


def against_baseline(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every source's counts next to what was expected: ok, differs, or unknown to the baseline."""
    both = stats.join(baseline.select("source", F.col("n_rows").alias("want_rows"), F.col("products").alias("want_products")), "source", "left")
    same = (F.col("n_rows") == F.col("want_rows")) & (F.col("products") == F.col("want_products"))
    return both.withColumn("verdict", F.when(F.col("want_rows").isNull(), "skipped").when(same, "ok").otherwise("differs"))


def rule_report(rules: DataFrame, most: int = 5) -> DataFrame:
    """How many rules there are, how many name a product, how many keys come twice, and the first such keys."""
    tidy = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    keyed = rules.where(tidy("product") != "").groupBy(tidy("source").alias("s"), F.when(tidy("category") == "", "*").otherwise(tidy("category")).alias("c"), tidy("product").alias("p"))
    per = keyed.agg(F.count("*").alias("n"), F.count_if(tidy("parent_sku") != "").alias("filled"))
    twice = F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.concat_ws("|", "s", "c", "p"))))
    return per.agg(F.sum("n").alias("rules"), F.sum("filled").alias("filled"), F.count_if(F.col("n") > 1).alias("duplicates"), F.slice(twice, 1, most).alias("first_duplicates"))
