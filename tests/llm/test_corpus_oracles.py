"""The numbered queries that have an SQL oracle give its rows, whole tables against whole tables."""

import duckdb
import pytest

from stocktide.llm import queries

SF = "/root/testdata/sf0.001"
EXTRA = [(-3, None, None, None, None), (-2, "", "aa", "s", 0), (-1, " \t\n", "aa", "s", 3), (10**12, "ABC abc é" * 40, "aa", "s", 1), (10**12 + 1, "x" + "ABC abc é" * 40, "aa", None, 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with awkward documents added."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.unionAll(spark.createDataFrame(EXTRA, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, tables, name):
    folder, duck = tables
    got = queries.queries()[name](spark, folder)
    names = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == names
    rows = lambda x: sorted((tuple(r) for r in x), key=repr)
    assert rows(got.select(*names).collect()) == rows(want.select(*names).fetchall())
