"""Temperature mixing of sources.

A source's share of the tokens is raised to an exponent; bisection finds the largest exponent (the mildest change) that
meets a target entropy and a repetition limit. The normalised weights are then realised: every source has a token budget, met
by whole passes over its documents and a last, partial one. Documents lie in hashed blocks of bounded size; a pass visits
blocks in order and permutes within them, and running totals over blocks and then within a block tell which documents
the partial pass takes.

Without a given budget it is the smallest that uses every document at least once, so that mixing repeats but never drops.
Cases: a null source is a source of its own; null and empty texts have no tokens and stay in whole passes; an empty
table gives no rows; repeated rows are documents of their own; other columns are kept when named.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
OUTPUTS = ("n_tokens", "weight", "pass_no", "block", "slot")
WORDS = r"[^\x20\x09-\x0D]+"


def temperature(tokens: list[int], target_entropy: float | None = None, max_repeat: float | None = None, budget: float | None = None) -> tuple[float, np.ndarray]:
    """(exponent, weights). `target_entropy` is a share of the largest possible one."""
    t = np.array(tokens, np.float64)
    some = t > 0
    if not some.any():
        return 1.0, np.zeros(len(t))

    def weights(a: float) -> np.ndarray:
        w = np.where(some, np.power(np.where(some, t / t.sum(), 1.0), a), 0.0)
        return w / w.sum()

    def repeats(w: np.ndarray) -> float:
        whole = budget if budget is not None else (t[some] / w[some]).max()
        return float((whole * w[some] / t[some]).max())

    def entropy(w: np.ndarray) -> float:
        return float(-(w[some] * np.log(w[some])).sum())

    least = (target_entropy or 0.0) * math.log(max(1, int(some.sum())))

    def bisect(good) -> float:
        """Largest exponent in 0..1 that is good; `good` holds up to some exponent."""
        if good(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    a = bisect(lambda x: entropy(weights(x)) >= least - 1e-12)
    if max_repeat is not None and repeats(weights(a)) > max_repeat:  # repetition falls as the exponent rises
        low, high = a, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if repeats(weights(mid)) <= max_repeat else (mid, high)
        a = high
    return a, weights(a)


def plan(rows: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: float | None) -> DataFrame:
    """A row per source: its weight, whole passes, tokens of the partial pass, and number of blocks."""
    sums = rows.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r["_source"] is not None, r["_source"] or ""))
    _, w = temperature([r["tokens"] for r in sums], target_entropy, max_repeat, budget)
    some = [i for i, r in enumerate(sums) if r["tokens"]]
    whole = budget if budget is not None else max((sums[i]["tokens"] / w[i] for i in some), default=0.0)
    out = []
    for i, r in enumerate(sums):
        repeat = whole * float(w[i]) / r["tokens"] if r["tokens"] else 1.0
        passes = math.floor(repeat + 1e-9)
        out.append((r["_source"], i, float(w[i]), passes, float(max(0.0, repeat - passes) * r["tokens"] if repeat - passes > 1e-9 else 0.0), max(1, -(-r["n"] // BLOCK_ROWS))))
    return rows.sparkSession.createDataFrame(out, "_source string, _sid int, weight double, passes int, partial double, blocks bigint")


def mix(docs: DataFrame, target_entropy: float | None = 0.97, max_repeat: float | None = 4.0, budget: float | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """A row for each use of a document: the `keep` columns, n_tokens, weight, pass_no, block and slot (place in the block's pass).

    A kept column named like one of the others comes as `doc_<name>`.
    """
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")
    digest = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(source_col).cast("string").alias("_source"), n_tokens.alias("_tokens"), digest.alias("_hash"))
    sources = F.broadcast(plan(rows, target_entropy, max_repeat, budget))
    by_source = F.col("d._source").eqNullSafe(F.col("s._source"))
    in_block = F.pmod(F.col("_hash"), F.col("blocks")).alias("block")
    # Sources go by number from here on: one exchange by (number, block) then serves the running totals, the join and the permutations.
    dealt = rows.alias("d").join(sources.alias("s"), by_source).select("d.*", "_sid", "weight", "passes", "partial", in_block)
    inside = Window.partitionBy("_sid", "block").orderBy("_hash", "kept")
    ordered = dealt.select("*", F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    # Totals come from the windows' own input, before it is widened: a slim row per block.
    totals = rows.alias("d").join(sources.alias("s"), by_source).groupBy("_sid", in_block).agg(F.sum("_tokens").alias("t"))
    before = totals.select("_sid", "block", (F.sum("t").over(Window.partitionBy("_sid").orderBy("block")) - F.col("t")).alias("_before"))
    joined = ordered.join(before, ["_sid", "block"])
    middle = F.col("_before") + F.col("_upto") - F.col("_tokens") / 2
    uses = F.col("passes") + F.when((F.col("_tokens") > 0) & (middle <= F.col("partial")), 1).otherwise(0)
    used = joined.withColumn("_uses", uses).where("_uses > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1)))
    place = Window.partitionBy("_sid", "block", "pass_no").orderBy(F.xxhash64(F.lit(seed), "pass_no", "_hash"), "kept")
    kept = [F.col(f"kept.{c}").alias(f"doc_{c}" if c in OUTPUTS else c) for c in keep]
    return used.select(*kept, F.col("_tokens").alias("n_tokens"), "weight", "pass_no", "block", (F.row_number().over(place) - 1).cast("bigint").alias("slot"))
