"""Shards of near-equal bytes from sampled splitters.

Records are ordered by a key (here the hash of the text, so equal texts lie together) and by id. Keys are sampled with
probability in proportion to their record's size; quantiles of the sample split the order into ranges. Ranges that turn out
overfull are sampled again, more densely, and subdivided, by id where one key fills them. Exact sizes of the
ranges, summed up in order, then place every record: a shard is the part of the running total that its start falls into.

Cases: a null text has size 8; null ids come first; repeated rows are records of their own; an empty table
gives no rows; a record larger than a shard's share makes its shard larger by at most that record; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocktide.llm.common import stored

OVERHEAD = 8
RANGES_PER_SHARD = 8
RANGE_ROWS = 250_000
SAMPLES_PER_RANGE = 16
LOWEST = -(1 << 63)


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")  # a digest that SQL has too
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def _range_of(splitters: list[tuple[int, int]]):
    """Column (key, id) -> number of splitters at or below it."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ids = np.array([i for _, i in splitters], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, doc_id: pd.Series) -> pd.Series:
        k, i = key.to_numpy(), doc_id.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for j in np.flatnonzero(low < high):
            out[j] = low[j] + np.searchsorted(ids[low[j] : high[j]], i[j], "right")
        return pd.Series(out.astype(np.int32))

    return place(F.col("key"), F.coalesce("doc_id", F.lit(LOWEST)))


def _sampled(rows: DataFrame, step: float, salt: int) -> list[tuple[tuple[int, int], float]]:
    """Keys drawn with probability size / step (all of those above), with the weight that each stands for."""
    draw = F.pmod(F.xxhash64(F.lit(salt), "key", "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    some = rows.where(draw * step < F.col("size")).select("key", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "size").collect()
    return sorted(((r["key"], r["doc_id"]), max(float(r["size"]), step)) for r in some)


def _quantiles(sample: list[tuple[tuple[int, int], float]], parts: int) -> list[tuple[int, int]]:
    if not sample or parts < 2:
        return []
    total = np.cumsum([w for _, w in sample])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return sorted({sample[i][0] for i in at})


def splitters(rows: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Range bounds; their number follows the rows, so that a range holds about RANGE_ROWS at most."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(shards * RANGES_PER_SHARD, -(-n // RANGE_ROWS))
    step = max(1.0, total / (parts * SAMPLES_PER_RANGE))
    bounds = _quantiles(_sampled(rows, step, 0), parts)
    for again in range(1, 3):
        sizes = rows.groupBy(_range_of(bounds).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        over = {r["range"]: max(r["bytes"] * parts / max(1, total), r["n"] * parts / max(1, n) / 4) for r in sizes}
        over = {r: x for r, x in over.items() if x > 2}
        if not over:
            break
        dense = _sampled(rows.where(_range_of(bounds).isin(*over)), step / 4**again, again)
        new: list[tuple[int, int]] = []
        for r, x in over.items():
            low, high = bounds[r - 1] if r else (LOWEST, LOWEST), bounds[r] if r < len(bounds) else None
            new += _quantiles([s for s in dense if s[0] >= low and (high is None or s[0] < high)], int(np.ceil(x)) * 2)
        if not set(new) - set(bounds):
            break
        bounds = sorted({*bounds, *new})
    return bounds


def shard(docs: DataFrame, shards: int = 24, **names) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    rows = stored(records(docs, **names), "records")
    bounds = splitters(rows, shards)
    placed = stored(rows.withColumn("range", _range_of(bounds)), "ranges")
    sums = {r["range"]: (r["bytes"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    before_bytes = np.cumsum([0, *(sums.get(r, (0, 0))[0] for r in range(len(bounds) + 1))])
    before_rows = np.cumsum([0, *(sums.get(r, (0, 0))[1] for r in range(len(bounds) + 1))])
    total = max(1, int(before_bytes[-1]))

    @F.pandas_udf("struct<byte:bigint,row:bigint>")
    def before(r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"byte": before_bytes[r.to_numpy()], "row": before_rows[r.to_numpy()]})

    order = Window.partitionBy("range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", F.sum("size").over(order).alias("upto"), F.count("*").over(order).alias("nth")).withColumn("b", before("range"))
    start = F.col("b.byte") + F.col("upto") - F.col("size")
    cut = summed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(start.cast("decimal(38,0)") * shards / total)).cast("int").alias("shard"), (F.col("b.row") + F.col("nth") - 1).alias("row"))
    cut = stored(cut, "shards")
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
