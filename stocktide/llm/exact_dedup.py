"""Exact duplicates by a tree-merge of sorted digest runs.

Texts count as equal when they are identical after each run of ASCII white space has become one space. A row travels as a digest of
that form (which orders runs and tells where a row belongs), its SHA-256 as proof, its id and its place; texts are hashed where they
are read and never shuffled. Every partition sorts its digests into a run and collapses equal ones. Runs are then merged in
rounds: partitions are numbered in digits to the base of the fan-in, and in round r the partitions that differ in digit r only
deal their runs out among themselves by that digit of the digest's own number, so that each receives a part of every run of its group
and merges the parts into one sorted run. After as many rounds as there are digits a digest has met all its copies, and no
partition has ever received more than one entry of a digest from each partition of its group, however many copies there are.
Entries merge only if digest and proof agree; the smallest identifier is kept at every level.

Cases: a null text is an empty one, as a text of white space is one space; a null id ranks behind all others; of rows that
share text and id (repeated rows) the first as stored stays; very long texts are hashed as a whole; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import join_counted, stored

FAN_IN = 8
WHITE_SPACE = r"[\x20\x09-\x0D]+"
RUN = "pid int, digest bigint, proof binary, missing boolean, id bigint, place bigint, size bigint"
ORDER = ("digest", "proof", "missing", "id", "place")
PROOF = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, proof, place) of every row."""
    form = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(form).alias("digest"), F.unhex(F.sha2(form, 256)).alias("proof"), F.monotonically_increasing_id().alias("place"))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where a new digest or proof begins in a sorted run."""
    digest, proof = batch.column("digest").to_numpy(), batch.column("proof")
    first = np.frombuffer(proof.buffers()[1], np.int32)[proof.offset]
    wide = np.frombuffer(proof.buffers()[2], np.uint8)[first : first + PROOF * len(proof)].reshape(-1, PROOF)
    return np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]) | (wide[1:] != wide[:-1]).any(1)])


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each digest and proof of a sorted run, batch by batch: the first (smallest) identifier, and the sum of sizes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # which columns may be null differs between batches
        if last is not None:
            batch = pa.concat_batches([last, batch])
        starts = _starts(batch)
        sizes = np.add.reduceat(batch.column("size").to_numpy(), starts)
        out = batch.take(pa.array(starts))
        out = pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(sizes)], names=out.schema.names)
        last = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if last is not None:
        yield last


def fan(partitions: int, fan_in: int = FAN_IN) -> tuple[int, int]:
    """(base, digits): the least fan-in and number of rounds that number at least so many partitions."""
    digits = max(1, math.ceil(math.log(max(2, partitions)) / math.log(fan_in) - 1e-9))
    base = next(b for b in range(2, fan_in + 1) if b**digits >= partitions)
    return base, digits


def merged_runs(rows: DataFrame, partitions: int, fan_in: int = FAN_IN) -> DataFrame:
    """Sorted runs, one a partition, in which every digest and proof of `rows` (as `records` gives them) comes once."""
    base, digits = fan(partitions, fan_in)
    whole = base**digits
    entry = rows.select(F.pmod(F.spark_partition_id(), F.lit(whole)).cast("int").alias("pid"), "digest", "proof", F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), "place", F.lit(1).cast("bigint").alias("size"))
    runs = entry.sortWithinPartitions(*ORDER).mapInArrow(collapse, RUN)
    for r in range(digits):
        digit = lambda number, unit=base**r: F.pmod(F.floor(number / unit), F.lit(base))
        own, wanted = digit(F.col("pid")), digit(F.pmod("digest", F.lit(whole)))
        dealt = runs.withColumn("pid", (F.col("pid") + (wanted - own) * base**r).cast("int"))
        runs = dealt.repartitionById(whole, F.col("pid")).sortWithinPartitions(*ORDER).mapInArrow(collapse, RUN)
    return runs


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; exactly one row of a group is kept."""
    spark = docs.sparkSession
    rows = stored(records(docs, id_col, text_col), "digests")
    found = stored(merged_runs(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in).select("digest", "proof", F.col("id").alias("keep_id"), F.col("place").alias("keep_place"), "size"), "runs")
    joined = join_counted(rows, found, ["digest", "proof"], "size")
    return joined.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("proof")).alias("text_sha256"))
