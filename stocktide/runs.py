"""Whole runs over a configuration: extract, diff, sync, rollback and map, each a function from stored tables to stored tables.

`settings` are those of `sources.files.configuration`. Under their `output_dir` lie the unified rows by source (`unified`), versions of the
catalogue (`catalogue`), diffs by run (`diff`) and the ledger of writes (`sync`). Reports for people are made from the results by `sinks`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stocktide.operators import extract, match, ordered, reconcile, sync
from stocktide.sinks import store
from stocktide.sinks import text as text_sinks
from stocktide.sources import files
from stocktide.sources.shop import Catalogue, Shop
from stocktide.storage import exists, stored


@dataclass(frozen=True)
class Work:
    """A configured shop and its folders."""

    spark: SparkSession
    settings: Mapping

    def folder(self, name: str) -> str:
        return f"{self.settings['paths']['output_dir'].rstrip('/')}/{name}"

    @property
    def shop(self) -> Shop:
        s = self.settings["store"]
        named = {"base_url": "base_url", "key": "consumer_key", "secret": "consumer_secret", "api_version": "api_version", "timeout": "timeout", "per_page": "per_page"}
        return Shop(**{k: s[v] for k, v in named.items()}, **{k: s[k] for k in ("attempts", "pause") if k in s})

    @property
    def catalogue(self) -> Catalogue:
        return Catalogue(self.spark, self.folder("catalogue"))

    @property
    def ledger(self) -> sync.Ledger:
        return sync.Ledger(self.spark, self.folder("sync"))

    def rules(self) -> DataFrame:
        return files.read_rules(self.spark, self.settings["paths"]["mapping_file"])

    def matching(self) -> dict:
        options = self.settings["options"]
        return {"combos": bool(options["include_combo_skus"]), "threshold": float(options["fuzzy_threshold"])}


def run_extract(work: Work, only: list[str] | None = None) -> DataFrame:
    """Read the configured sources (or some of them) into the unified table; gives rows and products of each, in order of configuration."""
    wanted = [s for s in work.settings["sources"] if not only or s["id"] in only]
    if not wanted:
        raise ValueError("no such source is configured")
    parts = []
    for source in wanted:
        rows = files.read_source(work.spark, source)
        # Where a row stands in its source, and what counts as a product: a name, or a block of a pick-sheet.
        sheet = isinstance(rows.schema["row"].dataType, StructType)
        at = F.array(*[F.col(f"row.{c}").cast("double") for c in ("page", "section", "column", "block", "top")]) if sheet else F.array(F.col("row").cast("double"))
        product = F.concat_ws("|", "row.page", "row.section", "row.column", "row.block") if sheet else F.col("source_product")
        parts.append(rows.select(*extract.UNIFIED, "file", at.alias("at"), product.alias("product")))
    rows = stored(extract.union_sources(parts), "sources")
    store.write_sources(rows, work.folder("unified"), [s["id"] for s in wanted], ["file", "at"])
    asked = work.spark.createDataFrame([(k, s["id"], s.get("label", s["id"])) for k, s in enumerate(wanted)], "place int, source string, label string")
    found = extract.source_stats(rows, "product")
    return asked.join(found, "source", "left").na.fill(0, ["n_rows", "products"]).orderBy("place").drop("place")


def run_diff(work: Work, run_id: str, refresh: bool = False) -> DataFrame:
    """The unified rows against the catalogue, kept under the run's id. Without mapping rules, suggestions are written for them first."""
    rows = store.read_sources(work.spark, work.folder("unified"))
    version = work.catalogue.pin(work.shop, refresh)
    if version is None:
        raise LookupError("the shop has no products")
    products, variations = work.catalogue.tables(version)
    path = work.settings["paths"]["mapping_file"]
    if not exists(work.spark, path):
        text_sinks.write_rules(_suggested(rows, products, None, {}), path)
    settings = work.settings["sync"]
    diffs = reconcile.build_diff(rows, products, variations, work.rules(), **work.matching(), mode=settings["mode"], update_status=settings["update_status"], no_qty_policy=settings["no_qty_policy"])
    target = f"{work.folder('diff')}/run_id={run_id}"
    diffs.withColumn("catalogue", F.lit(version)).write.mode("overwrite").parquet(target)
    return work.spark.read.parquet(target)


def run_sync(work: Work, run_id: str, sources: list[str] | None = None, needle: str = "", confirmed: bool = False, answer: str | None = None, refresh: bool = False, **how) -> DataFrame:
    """Diff anew and write the changes back (those of some sources, or that hold a text); a rehearsal unless confirmed."""
    diffs = run_diff(work, run_id, refresh)
    version = diffs.select("catalogue").first()
    changes = reconcile.select_changes(diffs.drop("catalogue"), sources, needle)
    _, variations = work.catalogue.tables(version[0]) if version else (None, work.spark.createDataFrame([], files.VARIATIONS))
    settings = work.settings["sync"]
    plan = sync.planned(changes, variations, settings["mode"], settings["update_status"], settings["no_qty_policy"])
    return sync.write_back(work.ledger, run_id, plan, work.shop.send, confirmed, answer, work.catalogue.forget, read=work.shop.variation, **how)


def run_resume(work: Work, run_id: str, confirmed: bool = False, answer: str | None = None, **how) -> DataFrame:
    """Go on with a run that broke off."""
    return sync.resume(work.ledger, run_id, work.shop.send, confirmed, answer, work.catalogue.forget, read=work.shop.variation, **how)


def run_rollback(work: Work, run_id: str, confirmed: bool = False, answer: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(results, totals) of taking a run back; a rehearsal unless confirmed."""
    return sync.undo(work.ledger, run_id, work.shop.send, confirmed, answer, work.catalogue.forget, read=work.shop.variation, **how)


def run_map(work: Work, write: bool = False, overwrite: bool = False, refresh: bool = False) -> DataFrame:
    """A rule for each product of the sources; with `write` they take the place of the rules that were there."""
    rows = store.read_sources(work.spark, work.folder("unified"))
    products, _ = work.catalogue.tables(work.catalogue.pin(work.shop, refresh))
    combos = {"combos": bool(work.settings["options"]["include_combo_skus"])}
    found = stored(_suggested(rows, products, None if overwrite else work.rules(), combos), "rules")
    if write:
        text_sinks.write_rules(found, work.settings["paths"]["mapping_file"])
    return found


def _suggested(rows: DataFrame, products: DataFrame, rules: DataFrame | None, how: dict) -> DataFrame:
    keyed = ordered.dense_occurrence_keys(rows.withColumnRenamed("source_product", "product"), "product", ["source", "category", "product"], "ord")
    return match.suggestions(keyed, products, rules, **how)
