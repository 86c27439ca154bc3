"""Updates of variations, sent from tasks by a data source's writer that keeps a ledger.

Each task sends its rows in chunks. What a chunk is about to send is on disk, closed, before the first of its sends, and how they ended is on
disk after the last one. A task that runs again reads the ledger first: what has an outcome isn't sent again, and what was announced
without one is compared with the shop, where that can be read, before it is sent. Chunks are rows of (product_id, variation_id,
request); their files are written under a name of their own, so that attempts never write over each other.

A run has many chunks, and a file for each would make the ledger slow to list and to read. So an announcement goes once its outcomes are on
disk, and an attempt merges its own files of outcomes, FAN at a time, until they have WHOLE bytes: the merged file is closed before those it
holds go, and rows that stand in both for a while are the same.

The folder of a ledger has to be one that tasks reach through pyarrow (a mounted path, or a store that it knows). Speculative execution must
be off for these jobs, since two attempts at once can't see each other's sends.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from stocktide.functions.text import raw_text
from stocktide.storage import exists

Send = Callable[[int, int, dict], dict]
Read = Callable[[int, int], dict]
IMAGE = "struct<sku:string,manage_stock:string,stock_quantity:bigint,stock_status:string>"
OUTCOME = f"product_id bigint, variation_id bigint, request string, ok boolean, after {IMAGE}, error string"
ANNOUNCED, ENDED = "announced", "ended"
ERROR_LENGTH = 400
CHUNK = 16
FAN, WHOLE = 16, 1 << 24


def attempt(send: Send, product: int, variation: int, request: str) -> dict:
    """Outcome of one send; every exception is a failure of this variation only."""
    try:
        return ended(product, variation, request, send(product, variation, json.loads(request)))
    except Exception as problem:  # noqa: BLE001
        return {"product_id": product, "variation_id": variation, "request": request, "ok": False, "after": None, "error": str(problem)[:ERROR_LENGTH]}


def ended(product: int, variation: int, request: str, after: dict | None) -> dict:
    after = after or {}
    image = {"sku": after.get("sku"), "manage_stock": raw_text(after.get("manage_stock")), "stock_quantity": after.get("stock_quantity"), "stock_status": after.get("stock_status")}
    return {"product_id": product, "variation_id": variation, "request": request, "ok": True, "after": image if after else None, "error": ""}


class Attempts:
    """The files of one run, as tasks see them."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.files, self.root = FileSystem.from_uri(folder)

    def add(self, part: int, kind: str, data: bytes) -> str:
        """A closed file of rows: it gets its name when it is whole."""
        folder = posixpath.join(self.root, f"part-{part}")
        self.files.create_dir(folder, recursive=True)
        path = posixpath.join(folder, uuid.uuid4().hex)
        with self.files.open_output_stream(f"{path}.new") as f:
            f.write(data)
        self.files.move(f"{path}.new", f"{path}.{kind}")
        return f"{path}.{kind}"

    def drop(self, path: str) -> None:
        self.files.delete_file(path)

    def of(self, part: int, kind: str) -> set[tuple[int, int]]:
        """Ids of the rows in a task's files of one kind."""
        from pyarrow.fs import FileSelector

        found = set()
        for info in self.files.get_file_info(FileSelector(posixpath.join(self.root, f"part-{part}"), allow_not_found=True)):
            if info.path.endswith(f".{kind}"):
                with self.files.open_input_stream(info.path) as f:
                    for line in f.read().splitlines():
                        row = json.loads(line)
                        found.add((row["product_id"], row["variation_id"]))
        return found


def lines(rows: list[dict]) -> bytes:
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


class Merged:
    """The outcomes of one attempt of a task, in few files. Files of other attempts, which a job may be reading, are left alone."""

    def __init__(self, book: Attempts, part: int):
        self.book, self.part = book, part
        self.levels: list[list[tuple[str, bytes]]] = []  # under WHOLE bytes each

    def add(self, data: bytes) -> None:
        self._put(0, self.book.add(self.part, ENDED, data), data)

    def close(self) -> None:
        self._merge([x for level in self.levels for x in level])

    def _put(self, level: int, path: str, data: bytes) -> None:
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        held.append((path, data))
        if len(held) < FAN and sum(len(d) for _, d in held) < WHOLE:
            return
        self.levels[level] = []
        path, data = self._merge(held)
        if len(data) < WHOLE:
            self._put(level + 1, path, data)

    def _merge(self, held: list[tuple[str, bytes]]) -> tuple[str, bytes] | None:
        if len(held) < 2:
            return held[0] if held else None
        data = b"".join(d for _, d in held)
        path = self.book.add(self.part, ENDED, data)
        for old, _ in held:
            self.book.drop(old)
        return path, data


@dataclass
class Sent(WriterCommitMessage):
    part: int
    sent: int
    failed: int
    repeated: int


class UpdateWriter(DataSourceWriter):
    def __init__(self, send: Send, folder: str, chunk: int, read: Read | None):
        self.send, self.folder, self.chunk, self.read = send, folder, chunk, read

    def write(self, rows: Iterator[Row]) -> Sent:
        part = TaskContext.get().partitionId()
        book = Attempts(self.folder)
        over, announced = book.of(part, ENDED), book.of(part, ANNOUNCED)
        done, outcomes = Sent(part, 0, 0, 0), Merged(book, part)
        waiting: list[tuple[int, int, str]] = []

        def outcome(product: int, variation: int, request: str) -> dict:
            if self.read is not None and (product, variation) in announced:
                now = self.read(product, variation) or {}
                if all(now.get(k) == v for k, v in json.loads(request).items()):
                    done.repeated += 1
                    return ended(product, variation, request, now)
            done.sent += 1
            return attempt(self.send, product, variation, request)

        def flush() -> None:
            said = book.add(part, ANNOUNCED, lines([{"product_id": p, "variation_id": v, "request": r} for p, v, r in waiting]))
            found = [outcome(*x) for x in waiting]
            outcomes.add(lines(found))
            book.drop(said)
            done.failed += sum(not x["ok"] for x in found)
            waiting.clear()

        for product, variation, request in rows:
            if (product, variation) in over:
                done.repeated += 1
                continue
            waiting.append((product, variation, request))
            if len(waiting) == self.chunk:
                flush()
        if waiting:
            flush()
        outcomes.close()
        return done

    def commit(self, messages: list[Sent]) -> None:
        """All tasks are through: the ledger says so, with their sums."""
        some = [m for m in messages if m is not None]
        Attempts(self.folder).add(-1, "summary", lines([{k: sum(getattr(m, k) for m in some) for k in ("sent", "failed", "repeated")}]))

    def abort(self, messages: list[Sent]) -> None:
        """What was sent was sent: the ledger stays as it is, and a later run goes on from it."""


def deliver(updates: DataFrame, send: Send, folder: str, writers: int = 4, chunk: int = CHUNK, read: Read | None = None) -> DataFrame:
    """Send updates (product_id, variation_id, request as JSON text; one row a variation) by `writers` tasks, and give their outcomes.

    Which task has a row depends on its ids only, so that a repeated task meets its own entries in the ledger.
    """
    spark = updates.sparkSession
    name = f"updates_{uuid.uuid4().hex}"

    class Updates(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return UpdateWriter(send, folder, chunk, read)

    spark.dataSource.register(Updates)
    updates.select("product_id", "variation_id", "request").repartition(writers, "product_id", "variation_id").write.format(name).mode("append").save()
    return outcomes(spark, folder)


def _rows(spark: SparkSession, folder: str, kinds: str, schema: str) -> DataFrame:
    """Rows of a ledger's files: the folders of its tasks are listed, not each file by itself."""
    if not exists(spark, f"{folder}/part-*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kinds}").json(folder)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How the sends of a ledger ended, one row a variation."""
    return _rows(spark, folder, ENDED, OUTCOME).dropDuplicates(["product_id", "variation_id"])


def announced(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, variation_id) of all that was to be sent, whether or not its end is known; some more than once."""
    return _rows(spark, folder, f"{{{ANNOUNCED},{ENDED}}}", "product_id bigint, variation_id bigint")
