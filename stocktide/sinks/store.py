"""The unified table as Parquet, a partition for each source. A source that is extracted again takes the place of its own rows only; sources
that aren't stay as they were, as their files would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.operators import extract
from stocktide.storage import exists, names, remove, stored

ROWS = "category string, source_product string, size string, quantity bigint, availability string, source_ref string, nth bigint"


def write_sources(rows: DataFrame, folder: str, extracted: list[str], order: list[str]) -> None:
    """Replace the rows of the `extracted` sources by `rows`; a source without any is emptied. `nth` is a row's place in its source."""
    kept = stored(rows.where(F.col("source").isin(extracted)), "extracted")
    placed = extract.numbered(kept, ["source", *order]).withColumnRenamed("ord", "nth").select(*extract.UNIFIED, "nth")
    # Each source's rows lie in ranges, so a large one is written by many tasks and a small one by few.
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(folder)
    some = {r[0] for r in kept.select("source").distinct().collect()}  # a row for each configured source
    for source in set(extracted) - some:
        remove(kept.sparkSession, f"{folder}/source={source}")


def stored_sources(spark: SparkSession, folder: str) -> list[str]:
    return [n.split("=", 1)[1] for n in names(spark, f"{folder}/source=*")]


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Unified rows as they come back from files (`extract.unified_again`), numbered by `ord` source by source, in order of their names."""
    if not exists(spark, f"{folder}/source=*"):
        raise FileNotFoundError(f"no unified rows in {folder}: extract first")
    rows = spark.read.schema(f"{ROWS}, source string").parquet(folder)
    return extract.numbered(extract.unified_again(rows), ["source", "nth"]).drop("nth")
