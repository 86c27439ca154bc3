"""Every query that has an SQL oracle gives the oracle's rows."""

import glob
import math
import os

import duckdb
import pytest

from stocktide.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(rows):
    clean = lambda v: "" if v is None else round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    assert canonical(got.select(*names).collect()) == canonical(want.select(*[f'"{n}"' for n in names]).fetchall())
