"""Matching of every row by brute force, and how many pairs it looks at."""

import re

from stocktide.operators import match
from stocktide.plans import registry

SF = "/root/testdata/sf0.001"


def alike(a, b):
    return len(a & b) / len(a | b)


def test_fuzzy_name_every(spark):
    parts = {r["p_partkey"]: set(re.split(r"[^0-9a-z]+", f"{r['p_brand']} {r['p_type']} {r['p_name']}".lower())) - {""} for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {}
    for i, a in parts.items():
        score, j = max((alike(a, b), -j) for j, b in parts.items() if j != i)
        if score >= 0.6:
            want[i] = -j
    got = {r["ord"]: r["product_id"] for r in registry.fuzzy_name_every(spark, SF).collect()}
    assert got == want and len(want) > len(parts) / 2


def test_frequent_tokens_emit_no_pairs(spark):
    names = [f"same group of{i} no{i} at{i // 2}" for i in range(60)]
    sets = [sorted(set(x.split())) for x in names]
    left, right = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "a int, lt array<string>"), spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "b int, rt array<string>")
    for threshold in (0.4, 0.6, 0.86):
        got = [(r["a"], r["b"]) for r in match.candidates(left, right, threshold).collect()]
        assert len(got) == len(set(got)) and (threshold < 0.6 or len(got) <= 2 * len(names))
        assert {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if alike(set(x), set(y)) >= threshold} <= set(got)


def test_nearest_sku_every(spark):
    norm = lambda x: re.sub("[^0-9A-Z]", "", x.upper())
    digits = lambda x: re.sub("[^0-9]", "", x)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    skus = {}
    names = [(r["p_partkey"], f"{r['p_brand']}-{r['p_partkey']}") for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    for i, s in sorted(names):
        skus.setdefault(norm(s), i)
    want = set()
    for _, s in names:
        k = norm(s + "X")
        near = sorted((d, digits(k) != digits(t), i) for t, i in skus.items() for d in [distance(k, t)] if d <= 2 or digits(k) == digits(t) != "")
        want |= {(s + "X", i, d, n) for n, (d, _, i) in enumerate(near[:3], 1)}
    got = {(r["key"], r["id"], r["distance"], r["place"]) for r in registry.nearest_sku_every(spark, SF).collect()}
    assert got == want and len({x[0] for x in got}) == len(names)
