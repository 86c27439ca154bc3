"""The shop's REST interface: products and variations page by page, and updates of variations."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stocktide import storage
from stocktide.functions.text import raw_text
from stocktide.sources import files
from stocktide.storage import stored

RETRIED = (429, 502, 503, 504)
TOTAL_PAGES = "x-wp-totalpages"  # fixed value
RAW = "product_id bigint, ord bigint, id bigint, sku string, attributes array<struct<option:string>>, manage_stock string, stock_quantity bigint, stock_status string"


class ShopError(RuntimeError):
    pass


@dataclass(frozen=True)
class Shop:
    """Requests that fail on the way, or with a status of RETRIED, are tried again after a growing pause."""

    base_url: str
    key: str = ""
    secret: str = ""
    api_version: str = "wc/v3"
    timeout: float = 60
    per_page: int = 100
    attempts: int = 3
    pause: float = 1.5

    @property
    def root(self) -> str:
        base = self.base_url.rstrip("/")
        return f"{base if base.startswith('http') else 'https://' + base}/wp-json/{self.api_version}"

    def answer(self, method: str, endpoint: str, params: dict | None = None, payload: dict | None = None) -> tuple[object, Mapping[str, str]]:
        """What the shop says (JSON if it is that), and the headers beside it."""
        url = f"{self.root}/{endpoint.lstrip('/')}" + ("?" + urllib.parse.urlencode(params) if params else "")
        body = None if payload is None else json.dumps(payload).encode()
        token = base64.b64encode(f"{self.key}:{self.secret}".encode()).decode()
        last = ""
        for attempt in range(self.attempts):
            try:
                asked = urllib.request.Request(url, body, {"Authorization": f"Basic {token}", "Content-Type": "application/json"}, method=method)
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    said, headers = answer.read().decode(), {k.lower(): v for k, v in answer.headers.items()}
                try:
                    return json.loads(said) if said else None, headers
                except json.JSONDecodeError:
                    return said, headers
            except urllib.error.HTTPError as problem:
                last = f"HTTP {problem.code}: {problem.read().decode(errors='replace')[:400]}"
                if problem.code not in RETRIED:
                    raise ShopError(f"{method} {url} -> {last}") from problem
            except OSError as problem:
                last = str(problem)
            time.sleep(self.pause * (attempt + 1))
        raise ShopError(f"{method} {url} failed again and again: {last}")

    def request(self, method: str, endpoint: str, params: dict | None = None, payload: dict | None = None):
        return self.answer(method, endpoint, params, payload)[0]

    def page(self, endpoint: str, page: int, **params) -> tuple[list[dict], int | None]:
        """One page, and how many the shop says there are."""
        found, headers = self.answer("GET", endpoint, {"per_page": self.per_page, "page": page, **params})
        total = headers.get(TOTAL_PAGES, "")
        return found or [], int(total) if total.isdigit() else None

    def pages(self, endpoint: str, start: int = 1, **params) -> Iterator[dict]:
        """Everything from a page on. Where the shop names no number of pages, one that isn't full is the last."""
        while True:
            chunk, total = self.page(endpoint, start, **params)
            yield from chunk
            if start >= total if total is not None else len(chunk) < self.per_page:
                return
            start += 1

    def variation(self, product_id: int, variation_id: int) -> dict:
        return self.request("GET", f"products/{product_id}/variations/{variation_id}")

    def send(self, product_id: int, variation_id: int, payload: dict) -> dict:
        return self.request("PUT", f"products/{product_id}/variations/{variation_id}", payload=payload)


@dataclass
class Pages(InputPartition):
    """Pages first..last of a listing (no end if last is None); the first page of all comes along, as it had to be asked for."""

    first: int
    last: int | None
    offset: int
    held: tuple[dict, ...] = ()


class CatalogReader(DataSourceReader):
    """Products in ranges of pages. The driver asks for the first page, which tells how many there are, and hands it on: every page is
    asked for once."""

    def __init__(self, shop: Shop, ranges: int):
        self.shop, self.ranges = shop, ranges

    def partitions(self) -> list[Pages]:
        held, total = self.shop.page("products", 1, status="any")
        if total is None and len(held) < self.shop.per_page:
            total = 1
        if total is None:
            return [Pages(1, 1, 0, tuple(held)), Pages(2, None, len(held))]
        cuts = [1 + round(k * (total - 1) / self.ranges) for k in range(self.ranges + 1)]
        rest = [Pages(a + 1, b, a * self.shop.per_page) for a, b in zip(cuts, cuts[1:]) if b > a]
        return [Pages(1, 1, 0, tuple(held)), *rest]

    def read(self, part: Pages) -> Iterator[tuple]:
        if part.held or part.last == 1:
            found = iter(part.held)
        elif part.last is None:
            found = self.shop.pages("products", part.first, status="any")
        else:
            found = (p for k in range(part.first, part.last + 1) for p in self.shop.page("products", k, status="any")[0])
        for k, p in enumerate(found, part.offset):
            yield p["id"], k, p.get("sku"), p.get("name"), p.get("type")


class RestCatalog(DataSource):
    """`spark.read.format("rest_catalog")`; the fields of `Shop` are its options, and `ranges`, the number of tasks beside the first page."""

    @classmethod
    def name(cls) -> str:
        return "rest_catalog"

    def schema(self) -> str:
        return files.PRODUCTS

    def reader(self, schema) -> CatalogReader:
        kinds = {"timeout": float, "per_page": int, "attempts": int, "pause": float}
        given = {k: kinds.get(k, str)(self.options[k]) for k in Shop.__dataclass_fields__ if self.options.get(k) is not None}
        return CatalogReader(Shop(**given), int(self.options.get("ranges", 8)))


def products(spark: SparkSession, shop: Shop, ranges: int = 8) -> DataFrame:
    """All products, with their place in the shop's order."""
    spark.dataSource.register(RestCatalog)
    return spark.read.format("rest_catalog").options(**asdict(shop), ranges=ranges).load()


def variations(products_: DataFrame, shop: Shop, readers: int = 4) -> DataFrame:
    """Variations of the variable products, asked for by `readers` tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for product in pdf["id"].tolist():
                rows = []
                for i, v in enumerate(shop.pages(f"products/{product}/variations")):
                    attributes = [{"option": a.get("option")} for a in v.get("attributes") or []]
                    rows.append((product, i, v["id"], v.get("sku"), attributes, raw_text(v.get("manage_stock")), v.get("stock_quantity"), v.get("stock_status")))
                if rows:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in RAW.split(", ")])

    asked = products_.where("type = 'variable'").select("id").repartition(readers)
    return files.shaped_variations(asked.mapInPandas(run, RAW), products_)


@dataclass(frozen=True)
class Catalogue:
    """Versions of a shop's catalogue in a folder. A manifest names the one that counts; it changes at once, when a version is whole, so a
    reader of an older version is never disturbed."""

    spark: SparkSession
    folder: str

    def _path(self, version: str, table: str) -> str:
        return f"{self.folder}/versions/{version}/{table}"

    def current(self, shop: Shop) -> str | None:
        """The version that counts, if it is of this shop."""
        said = storage.read_text(self.spark, f"{self.folder}/current.json")
        manifest = json.loads(said) if said else {}
        return manifest.get("version") if manifest.get("base_url") == shop.base_url else None

    def tables(self, version: str) -> tuple[DataFrame, DataFrame]:
        """(products, variations) of a version, whatever counts later."""
        return self.spark.read.parquet(self._path(version, "products")), self.spark.read.parquet(self._path(version, "variations"))

    def refresh(self, shop: Shop) -> str | None:
        """Ask the shop and make that the version that counts. Without products nothing is kept: None."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        products(self.spark, shop).write.parquet(self._path(version, "products"))
        kept = self.spark.read.parquet(self._path(version, "products"))
        if kept.isEmpty():
            storage.remove(self.spark, f"{self.folder}/versions/{version}")
            return None
        variations(kept, shop).write.parquet(self._path(version, "variations"))
        storage.put_text(self.spark, f"{self.folder}/current.json", json.dumps({"version": version, "base_url": shop.base_url}))
        return version

    def pin(self, shop: Shop, refresh: bool = False) -> str | None:
        """The version to work with: the one that counts, or a new one."""
        return (None if refresh else self.current(shop)) or self.refresh(shop)

    def forget(self) -> None:
        """No version counts any more, after writes to the shop; those being read stay."""
        storage.remove(self.spark, f"{self.folder}/current.json")

    def prune(self, keep: int = 2) -> list[str]:
        """Remove all but the newest versions; gives the removed ones."""
        old = storage.names(self.spark, f"{self.folder}/versions/*")[:-keep]
        for version in old:
            storage.remove(self.spark, f"{self.folder}/versions/{version}")
        return old


def catalogue(spark: SparkSession, shop: Shop, cache: str | None = None, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(products, variations): the kept version if there is one of this shop that has products, else asked for and kept."""
    if cache:
        kept = Catalogue(spark, cache)
        version = kept.pin(shop, refresh)
        if version:
            return kept.tables(version)
    some = stored(products(spark, shop), "products")
    return some, stored(variations(some, shop), "variations")


def forget(spark: SparkSession, cache: str) -> None:
    """The kept catalogue no longer counts, after writes to the shop."""
    Catalogue(spark, cache).forget()
