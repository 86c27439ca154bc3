"""Near-duplicate groups by one-permutation hashing with optimal densification.

Each distinct set of shingles gets a sketch of BINS bins from a single hash of every shingle; an empty bin borrows from the first
filled bin in an order that hashes fix for it. Bands of ROWS bins are bucket keys. Within a bucket only
star edges from a centre are candidates; full sets confirm them. Members that a star leaves outside its centre's group are tried
again with the best-linked member as centre. What is still apart at the end is compared by whole sketches, in blocks
of a bucket, and pairs that may reach the similarity are confirmed on full sets. Components come from alternating large and small stars.

Cases: rows that share an id are one node; rows with null id link with nothing and are kept; texts without words
(null ones too) have an empty set and link with nothing; equal sets are one node from the start, whatever
their number; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import discard, slices, small_batches, stored

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
POWER = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, sketch binary"
BLOCK = 2000
SIGMAS = 3.5


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: For each bin, the order in which it looks for a filled one: by a hash of the two.
    PROBES = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + POWER).reshape(BINS, BINS), axis=1)


def shingle_hashes(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (sorted), laid end to end, and how many each text has.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle.
    """
    raw = [b" " + (t or "").encode().lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int((ends - starts).max()) + 1, POWER, np.uint64))
        begin = np.repeat(starts, ends - starts)
        at = np.arange(len(begin)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        terms = (data[begin + at].astype(np.uint64) + np.uint64(1)) * powers[at]
        word = mix(np.add.reduceat(terms, np.cumsum(ends - starts) - (ends - starts)))
        of = np.searchsorted(bounds, starts, "right") - 1
        n_words = np.bincount(of, minlength=len(texts))
        first = np.cumsum(n_words) - n_words
        salts = mix(np.arange(1, words + 1, dtype=np.uint64) * POWER)
        full = np.flatnonzero(np.arange(len(word)) + words <= np.repeat(first + n_words, n_words))
        h = np.zeros(len(full), np.uint64)
        for k in range(words):
            h = mix(h ^ word[full + k]) * salts[k]
        h = mix(h)
        owner = of[full]
        for i in np.flatnonzero((n_words > 0) & (n_words < words)):
            x = np.uint64(n_words[i])
            for w in word[first[i] : first[i] + n_words[i]]:
                x = mix(np.array([x ^ w]))[0] * salts[0]
            h, owner = np.append(h, mix(np.array([x]))), np.append(owner, i)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.bincount(owner, minlength=len(texts))


def sketches(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densified one-permutation sketch of every set, and which of its bins the set itself fills."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    with np.errstate(over="ignore"):
        bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        values = mix(h + POWER)
    out = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(owner * BINS + bins, kind="stable")
    key = (owner * BINS + bins)[order]
    if len(key):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out[key[start]] = np.minimum.reduceat(values[order], start)
    filled = np.zeros(n * BINS, bool)
    filled[key] = True
    out, own = out.reshape(n, BINS), filled.reshape(n, BINS)
    filled = own.copy()
    row, col = np.nonzero(~filled & (counts > 0)[:, None])
    for attempt in range(BINS):
        if not len(row):
            break
        source = PROBES[col, attempt]
        hit = filled[row, source]
        out[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return out, own


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            keys = mix(keys ^ sketch[:, r::ROWS][:, :BANDS]) * POWER
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return keys.view(np.int64)


def sketch_rows(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of shingles, a 128-bit key of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            h, counts = shingle_hashes(batch.column("text").to_pylist(), words)
            bins, own = sketches(h, counts)
            keys = band_keys(bins)
            short = (bins >> np.uint64(32)).astype(np.uint32)
            packed = np.packbits(own, axis=1)
            with np.errstate(over="ignore"):
                ends = np.cumsum(counts)
                sums = [np.r_[np.uint64(0), np.cumsum(x)] for x in (mix(h ^ POWER), mix(h * POWER + np.uint64(7)))]
                s1, s2 = ((s[ends] - s[ends - counts]).view(np.int64) for s in sums)
            some = counts > 0
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some * BANDS)], pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(s1), pa.array(s2), lists, pa.array([x.tobytes() + y.tobytes() for x, y in zip(short, packed)], pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, hashes): the sorted shingle hashes of every row, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            h, counts = shingle_hashes(batch.column("text").to_pylist(), words)
            ends = np.cumsum(counts)
            sets = pa.array([h[end - n : end].tobytes() for end, n in zip(ends, counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id bigint, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                small, large = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(small) > len(large):
                    small, large = large, small
                both = 0
                if len(small):
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                keep.append(both > 0 and 100 * both >= percent * (len(small) + len(large) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"hashes_{x}"))
    full = pairs.join(side("b"), "b").join(side("a"), "a")
    return full.select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a bigint, b bigint").distinct()


def alike(open_: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different components whose whole sketches agree as pairs of the wanted similarity do
    (SIGMAS standard deviations allowed), and whose bins don't prove too many differences: each bin that the two sets fill
    differently, or only one of them fills, holds a shingle of just one set, and sets of p percent differ in at most
    (100 - p) / (100 + p) of their summed sizes. Members are compared in blocks, and only pairs that agree are given out, by
    their first common band."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, band = key[1], key[2], int(pdf["band"].iat[0])
        pdf = pdf.sort_values("rep", ignore_index=True)
        raw = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        bins = np.ascontiguousarray(raw[:, : 4 * BINS]).view(np.uint32)
        own = np.unpackbits(raw[:, 4 * BINS :], axis=1, count=BINS).astype(bool)
        n, component, block, rep = (pdf[c].to_numpy() for c in ("n", "component", "block", "rep"))
        out = []
        for k in range(len(rep)):
            rest = np.flatnonzero((component != component[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])) & (rep > rep[k] if i == j else (block == j) & (block[k] == i)))
            if not len(rest):
                continue
            equal = bins[rest] == bins[k]
            effective = np.minimum(BINS, 0.75 * np.minimum(n[rest], n[k]) + 1)
            least = percent / 100 - SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / effective)
            apart = (own[rest] ^ own[k] | own[rest] & own[k] & ~equal).sum(1)
            good = (equal.mean(1) >= least) & ((100 + percent) * apart <= (100 - percent) * (n[rest] + n[k]))
            first = equal[good].reshape(-1, BANDS, ROWS).all(2).argmax(1)
            out += [(min(int(rep[k]), int(rep[x])), max(int(rep[k]), int(rep[x]))) for x in rest[good][first == band]]
        return pd.DataFrame(out, columns=["a", "b"])

    # The only pair of a bucket of two has been a star's edge.
    blocks = open_.groupBy("key").agg(F.count("*").alias("size")).where("size > 2").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(sketches, "rep").select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "band", "rep", "n", "component", "block", "sketch")
    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Alternating stars: minima are aggregated before they are joined back, so that a hub isn't gathered anywhere.
    """
    tree, old = stored(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).where("node != to").distinct(), "stars"), None
    state = None
    while True:
        both = tree.unionAll(tree.select(F.col("to").alias("node"), F.col("node").alias("to")))
        low = both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("low"))
        large = both.where("to > node").join(low, "node").select(F.col("to").alias("node"), F.col("low").alias("to")).where("node != to").distinct()
        least = large.groupBy("node").agg(F.min("to").alias("low"))
        small = large.join(least, "node").select(F.col("to").alias("node"), F.col("low").alias("to")).unionAll(least.select("node", F.col("low").alias("to")))
        tree, old = stored(small.where("node != to").distinct(), "stars"), tree
        discard(old)
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = tree.select(F.col("to").alias("node")).distinct()
    return tree.select("node", F.col("to").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    small_batches(docs.sparkSession)
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    sketched = stored(sketch_rows(docs, words, id_col, text_col), "sketches")
    filled = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    sets = sketched.where(filled).groupBy("n_shingles", "s1", "s2").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("m"))
    sets = kept(sets.select("n_shingles", "s1", "s2", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands"), F.col("m.sketch").alias("sketch")), "sets")
    rows = stored(sketched.drop("bands", "sketch"), "rows")
    discard(sketched)
    members = sets.select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1").select("key", "centre")
    close = kept(members.join(shared, "key"), "buckets")  # rep, n, band, key, centre
    reps = kept(close.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    full = kept(full_sets(base.join(reps, "doc_id", "left_semi"), words), "full")
    # Rows that share an id are one node: every set of theirs leads to the id.
    same = rows.where(filled).join(sets.select("n_shingles", "s1", "s2", "rep"), ["n_shingles", "s1", "s2"]).where("doc_id != rep")
    same = kept(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "same")

    tested = kept(close.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = kept(confirmed(tested, full, percent), "links")
    spanning = links  # edges that hold together what is linked so far
    for attempt in range(hub_rounds + 1):
        groups = kept(components(spanning), "groups")
        spanning = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        at = close.select("rep", "n", "band", "key").join(groups, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
        apart = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        open_ = kept(at.join(apart, "key"), "open")
        if open_.isEmpty():
            break
        if attempt < hub_rounds:
            degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
            ranked = open_.join(degree, "rep", "left").select("key", "rep", "n", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
            hub = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("low"), "rep", "n", "component")).alias("hub"))
            alike_enough = f"component != hub.component and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)"
            new = ranked.join(hub, "key").where(alike_enough).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
        else:
            new = alike(open_, sets.select("rep", "sketch"), percent)
        new = kept(new.distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionAll(new)
        found = kept(confirmed(new, full, percent), "links")
        links, spanning = links.unionAll(found), spanning.unionAll(found)
    groups = stored(components(spanning.unionAll(same)), "groups")
    for table in made:
        discard(table)
    joined = rows.join(groups, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
