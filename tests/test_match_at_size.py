"""How many pairs the searches look at, on names of frequent words only and on identifiers of the same digits."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stocktide.operators import match
from stocktide.storage import stored


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.86, 1.0])
def test_signatures_lose_no_pair(spark, threshold):
    rng = random.Random(3)
    sets = [frozenset(rng.sample([f"w{k}" for k in range(18)], rng.randint(2, 9))) for _ in range(250)]
    side = lambda c: spark.createDataFrame([(sorted(s),) for s in set(sets)], f"{c} array<string>")
    got = match.candidates(side("lt"), side("rt"), threshold).collect()
    pairs = {(frozenset(r["lt"]), frozenset(r["rt"])) for r in got}
    assert len(pairs) == len(got)  # each pair once
    assert {(a, b) for a, b in itertools.product(set(sets), repeat=2) if jaccard(a, b) >= threshold} <= pairs


def test_signature_plan_keeps_to_its_bound():
    for n, m, s, left, right in match.signature_plan(0.6, list(range(2, 30)), list(range(2, 30))):
        assert 1 <= s and all(len(c) == s for c in left + right)
        assert s == 1 or max(len(left), len(right)) <= match.SIGNATURES


def test_names_of_frequent_words_meet_in_few_pairs(spark):
    """Twelve words, each in half of all names; names of six words meet only if five of them are the same."""
    words = ["steel", "copper", "large", "small", "plated", "brushed", "red", "blue", "box", "bag", "promo", "standard"]
    names = [" ".join(c) for c in itertools.combinations(words, 6)]
    rows = spark.createDataFrame(list(enumerate(names)), "ord long, product string")
    sets = stored(rows.select(F.array_sort(F.split("product", " ")).alias("t")), "sets")
    pairs = match.candidates(sets.withColumnRenamed("t", "lt"), sets.withColumnRenamed("t", "rt"), 0.7).count()
    assert len(names) == 924 and pairs <= 924 * 37  # itself and the 36 names with one word less in common
    products = rows.select(F.col("ord").alias("id"), "ord", F.col("product").alias("name"))
    assert match.by_similarity(rows, products, 0.86).where("ord = product_id").count() == 924


def test_a_frequent_set_of_words_meets_once(spark):
    """A third of all names have the same words: they are one on either side, and every row gets its match."""
    rows = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("red  box "), F.repeat(F.lit("!"), (F.col("id") % 50).cast("int")))).otherwise(F.concat(F.lit("box "), F.col("id"))).alias("product"))
    products = rows.select((F.col("ord") + 7).alias("id"), "ord", F.col("product").alias("name"))
    got = {r["ord"]: r["product_id"] for r in match.by_similarity(rows, products, 0.86).collect()}
    assert len(got) == 3000 and all(got[k] == (7 if k % 3 == 0 else k + 7) for k in got)
    others = {r["ord"]: r["product_id"] for r in match.by_similarity(rows.withColumn("ord", F.col("ord") + 7), products, 0.86, others=True).collect()}
    assert others[7] == 10 and others[10] == 7 and others[3004] == 7


def test_one_group_of_digits_is_searched_in_few_pairs(spark, monkeypatch):
    """4000 identifiers of the same digits; their neighbours are three edits off. Pairs stay near the number of identifiers."""
    letters = "ABCDEGHKLM"
    skus = [f"SP5-{''.join(letters[int(d)] * 2 for d in f'{k:04d}')}" for k in range(4000)]
    products = spark.createDataFrame([(k, k, s) for k, s in enumerate(skus)], "id long, ord long, sku string")
    wanted = spark.createDataFrame([(s + "X",) for s in skus[::40]] + [("SP5-QQQQQQQQQQQQ",)], "key string")
    kept = {}
    keep = match.stored
    monkeypatch.setattr(match, "stored", lambda df, name: kept.setdefault(name, []).append(keep(df, name)) or kept[name][-1])
    got = match.nearest_sku(wanted, products).collect()
    looked = sum(t.count() for t in kept.get("same", []))
    assert looked < 60 * 101

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for key in ("SP5-QQQQQQQQQQQQ", skus[0] + "X", skus[80] + "X"):
        plain = key.replace("-", "")
        want = sorted((edits(plain, s.replace("-", "")), k) for k, s in enumerate(skus))[:3]
        assert [(r["distance"], r["id"]) for r in sorted(got, key=lambda r: r["place"]) if r["key"] == key] == want
