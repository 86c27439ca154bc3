"""Logic that depends on row order. Order is always an explicit column, and windows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions import text


def forward_fill(df: DataFrame, col: str, by: list[str], order: str, out: str) -> DataFrame:
    """Empty cells take the last filled one; a cell of white space only is filled, with ''."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(F.col(col) != "", text.strip(F.col(col))), ignorenulls=True).over(w))


def drop_consecutive(df: DataFrame, cols: list[str], by: list[str], order: str) -> DataFrame:
    """Of neighbouring rows that are equal in `cols` the first stays."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def islands(df: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """`block`: number of the run of equal keys among the runs of that key; `blocks`: how many there are."""
    w = Window.partitionBy(*by).orderBy(order)
    start = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    own = Window.partitionBy(*by, key)
    flagged = df.withColumn("_start", start)
    return flagged.withColumn("block", F.sum("_start").over(own.orderBy(order))).withColumn("blocks", F.sum("_start").over(own)).drop("_start")


def occurrence_keys(df: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """`occurrence`: the key, with `#n` if it comes in several runs."""
    out = islands(df, key, by, order)
    return out.withColumn("occurrence", F.when(F.col("blocks") > 1, F.concat(key, F.lit("#"), "block")).otherwise(F.col(key)))


def dense_occurrence_keys(df: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """`occurrence` of `key` over one global order that counts 1, 2, 3, ...: a run of equal `by` goes on where the row before has the same.

    Partitions are as small as the runs' keys, so that one large source is no hot partition.
    """
    own = Window.partitionBy(*by)
    start = F.when(F.lag(order).over(own.orderBy(order)) == F.col(order) - 1, 0).otherwise(1)
    flagged = df.withColumn("_start", start)
    flagged = flagged.withColumn("_block", F.sum("_start").over(own.orderBy(order))).withColumn("_blocks", F.sum("_start").over(own))
    return flagged.withColumn("occurrence", F.when(F.col("_blocks") > 1, F.concat(key, F.lit("#"), "_block")).otherwise(F.col(key))).drop("_start", "_block", "_blocks")


def split_blocks(df: DataFrame, rank: str, position: str, by: list[str], order: str, gap: float = 90.0) -> DataFrame:
    """`part`: a new one starts where the rank doesn't rise or the position leaps by more than `gap`. Rows without a rank are left out first."""
    df = df.where(F.col(rank).isNotNull())
    w = Window.partitionBy(*by).orderBy(order)
    cut = F.when((F.col(rank) <= F.lag(rank).over(w)) | (F.col(position) - F.lag(position).over(w) > gap), 1).otherwise(0)
    return df.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(w) + 1).drop("_cut")


def anchored_groups(df: DataFrame, position: str, by: list[str], reach: float, out: str = "group") -> DataFrame:
    """`out`: number of the group of each row, from 1: in order of position a row joins the group whose FIRST member lies within `reach`.

    The fold runs over the distinct positions of each `by`, in one aggregate: positions on a page, not rows of a table.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<p:double,n:int>>").alias("done"))

    def step(state: Column, p: Column) -> Column:
        joins = state["anchor"].isNotNull() & (p - state["anchor"] <= reach)
        n = F.when(joins, state["n"]).otherwise(state["n"] + 1)
        return F.struct(n.alias("n"), F.when(joins, state["anchor"]).otherwise(p).alias("anchor"), F.concat(state["done"], F.array(F.struct(p.alias("p"), n.alias("n")))).alias("done"))

    positions = df.groupBy(*by).agg(F.array_sort(F.collect_set(F.col(position).cast("double"))).alias("ps"))
    folded = positions.select(*by, F.explode(F.aggregate("ps", start, step, lambda s: s["done"])).alias("g")).select(*by, F.col("g.p").alias("_p"), F.col("g.n").alias(out))
    return df.withColumn("_p", F.col(position).cast("double")).join(folded, [*by, "_p"]).drop("_p")


def first_wins(df: DataFrame, key: Column | str, value: str, order: str) -> DataFrame:
    """One row per key: its first value by order."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("key")).agg(F.min_by(value, order).alias(value))
