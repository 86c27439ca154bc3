"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stocktide.storage import fresh, remove

BATCH_BYTES = 4 << 20
HOT_KEYS = 1024


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The tables go with the application."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        remove(df.sparkSession, path)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB at most, where the session doesn't say otherwise: ten thousand texts in one fill a worker's memory,
    and the executor's, in the other process, too. Batches of slim rows stay as they are."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of the column: sizes groups in proportion to the data."""
    return docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def lowest_by_hash(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n rows of the smallest key hashes, one of each key. A bound on the hash, from a count of the keys, keeps what the tasks
    hand in near n in all."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    total = rows.agg(F.approx_count_distinct(place)).first()[0]
    if total > 4 * n:
        rows = rows.where(place < F.lit(int(2.5 * n / total * (1 << 40))))
    others = [F.first(c).alias(c) for c in rows.columns if c not in key]
    once = rows.groupBy(*key).agg(*others) if others else rows.select(*key).distinct()
    return once.orderBy(place, *key).limit(n).select(*rows.columns)


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the facts of their key. `facts` has a row for each key and counts how often the key comes in `rows`.

    Fewer than HOT_KEYS keys can hold over one in HOT_KEYS of all rows: these are broadcast, so that rows of a hot key stay where they
    are. Rows of the other keys are shuffled, at most one in HOT_KEYS of them to a task by one key.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) * HOT_KEYS > F.lit(total)
    hot, others = F.broadcast(facts.where(frequent)), facts.where(~frequent)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(others, keys))


def slices(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose text column stays near `limit` bytes (one row at least)."""
    for batch in batches:
        lengths = batch.column(column)
        if pa.types.is_string(lengths.type) or pa.types.is_binary(lengths.type):
            offsets = np.frombuffer(lengths.buffers()[1], np.int32)[lengths.offset : lengths.offset + len(lengths) + 1] if len(lengths) else np.zeros(1, np.int32)
        else:
            offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1] if len(lengths) else np.zeros(1, np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(n, max(start + 1, end))
            yield batch.slice(start, end - start)
            start = end


def kept_as(keep: tuple[str, ...], outputs: tuple[str, ...]) -> list[Column]:
    """The kept columns; one named like an output comes as `doc_<name>`, and a name that is asked for twice comes once."""
    return [F.col(f"`{c}`").alias(f"doc_{c}" if c in outputs else c) for c in dict.fromkeys(keep)]


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)
