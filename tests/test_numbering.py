"""Global numbers over wide rows: complete, without gaps and in order, however the engine plans its shuffles."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stocktide.operators import extract
from stocktide.storage import stored


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.fixture()
def plain_plans(spark):
    """Without adaptive execution, which puts small ranges together."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def _wide(spark, n, width):
    pad = F.concat_ws("-", *[F.sha2(F.concat("id", F.lit(k)).cast("string"), 256) for k in range(width)])
    return spark.range(n, numPartitions=13).select((F.col("id") * 7919 % n).alias("key"), pad.alias("pad"))


@pytest.mark.parametrize("n, width", [(120_000, 12), (5_000_000, 1)])
def test_numbers_of_wide_rows(spark, adaptive, n, width):
    """7919 and n have no common factor: keys are 0 .. n - 1, so a row's number is its key and one."""
    rows = stored(_wide(spark, n, width), "wide")
    got = extract.numbered(rows, ["key"]).agg(F.count("*"), F.count_if(F.col("ord") == F.col("key") + 1), F.count_distinct("ord"), F.min(F.length("pad"))).first()
    assert tuple(got)[:3] == (n, n, n) and got[3] >= 64


def test_numbers_are_those_of_row_number(spark, adaptive):
    """Several keys, nulls and a key that holds two thirds of the rows; equal rows have numbers of their own."""
    rows = spark.range(30_000, numPartitions=7).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.nullif(F.col("id") % 11, F.lit(4))).alias("a"), (F.col("id") % 50).alias("b"), F.lit("x" * 500).alias("c"))
    got = extract.numbered(rows, ["a", F.desc("b")])
    want = rows.select("a", "b", F.row_number().over(Window.orderBy("a", F.desc("b"))).alias("ord"))
    assert sorted(map(tuple, got.select("ord", F.coalesce("a", F.lit(-1)), "b").collect())) == sorted(map(tuple, want.select("ord", F.coalesce("a", F.lit(-1)), "b").collect()))
    assert extract.numbered(rows.where("false"), ["a"]).count() == 0


def test_a_frequent_row_is_cut_into_ranges(spark, monkeypatch, plain_plans):
    """Even rows without any difference don't meet in one task."""
    kept = []
    monkeypatch.setattr(extract, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    rows = spark.range(40_000, numPartitions=8).select(F.lit("same").alias("a"))
    assert extract.numbered(rows, ["a"]).agg(F.count_distinct("ord"), F.max("ord")).first() == (40_000, 40_000)
    assert max(r["count"] for r in kept[0].groupBy(F.shiftright("_at", extract.PLACE_BITS)).count().collect()) < 20_000
