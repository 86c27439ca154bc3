"""Resampling documents towards the words of a target, by the importance of hashed features.

Features are runs of up to `grams` consecutive words, hashed into buckets. A bucket's gain is the logarithm of how much more
frequent it is in the target than in the corpus; a document's weight is the mean gain of its features, and adding Gumbel
noise that hashes fix draws documents without replacement.

Segments are worked once. Newlines cut texts into lines; each distinct line of the corpus has its features counted once, and the counts
are multiplied by how often the line occurs. No word holds a newline, so only runs of several words can cross lines: these
are counted apart, document by document, from the words next to the cuts. Documents carry 128-bit digests of their lines; a line's sum of
gains is joined to them, the sums of the fewer than 1024 most frequent lines by broadcast, so that no line is a hot key.

Cases: a null text has no words; a document without features weighs 0; ties in score go to the smaller id, then to the row that is stored
first (repeated rows); a null id is hashed as an empty text and ranks last; a very long line or text is counted whole; other
columns are ignored, whatever their names; an empty corpus gives no rows, an empty target counts nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.llm.common import join_counted, slices, small_batches, stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 10_000
LEAST_WORDS = 20
TASK_LINES = 20_000
SCALE = 1000
FEATURES = "line binary, occurrences bigint, words bigint, features array<int>"


class _Buckets(dict):
    """Bucket of a feature; those seen before are looked up."""

    def __init__(self, buckets: int, most: int = 1 << 20):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def runs(words: list[bytes], grams: int) -> list[bytes]:
    """All runs of 1 to `grams` consecutive words."""
    out = list(words)
    for n in range(2, grams + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def crossing_runs(text: bytes, grams: int) -> list[bytes]:
    """Runs of 2 to `grams` words that don't lie within one line: only grams - 1 words on either side of a cut can be in one."""
    near: list[tuple[int, bytes]] = []
    stretches = [near]
    for k, line in enumerate(text.split(b"\n")):
        words = WORD.findall(line)
        if len(words) > 2 * (grams - 1):
            near += [(k, w) for w in words[: grams - 1]]
            near = [(k, w) for w in words[len(words) - grams + 1 :]]
            stretches.append(near)
        else:
            near += [(k, w) for w in words]
    return [b" ".join(w for _, w in s[i : i + n]) for s in stretches for n in range(2, grams + 1) for i in range(len(s) - n + 1) if s[i][0] != s[i + n - 1][0]]


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, pa.int32()))


def line_features(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """A row for each distinct line of `texts` (text) that isn't empty: its digest, occurrences, number of words and features' buckets."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("occurrences"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            for part in slices([batch]):
                words = [WORD.findall(x.lower()) for x in part.column("text").to_pylist()]
                found = words if grams == 1 else [runs(w, grams) for w in words]
                flat = np.fromiter((known[f] for fs in found for f in fs), np.int32)
                yield pa.RecordBatch.from_arrays([part.column("line"), part.column("occurrences"), pa.array([len(w) for w in words], pa.int64()), _lists(flat, [len(f) for f in found])], names=["line", "occurrences", "words", "features"])

    return lines.select(digest(F.col("text")).alias("line"), F.col("text").cast("binary").alias("text"), "occurrences").mapInArrow(count, FEATURES)


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def crossing_features(rows: DataFrame, grams: int, buckets: int) -> DataFrame:
    """(place, features) of what crosses the lines of each row (place, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in slices(batches):
            found = [crossing_runs(x.lower(), grams) for x in batch.column("text").to_pylist()]
            flat = np.fromiter((known[f] for fs in found for f in fs), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("place"), _lists(flat, [len(f) for f in found])], names=["place", "features"])

    return rows.select("place", F.col("text").cast("binary").alias("text")).mapInArrow(count, "place bigint, features array<int>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of every bucket in the stored (occurrences, features): counted by each task, summed, and `buckets` numbers in all. A
    task gets TASK_LINES lines at least, so that what it hands on is far less than what it reads, however finely the table is cut."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, lengths = batch.column("features").flatten().to_numpy(), batch.column("features").value_lengths().to_numpy()
            total += np.bincount(flat, np.repeat(batch.column("occurrences").to_numpy(), lengths), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    tasks = max(1, features.count() // TASK_LINES)
    for r in features.select("occurrences", "features").coalesce(tasks).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(SCALE * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def summed(features: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The `keep` columns, the sum of gains and the number of features of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("features").value_lengths().to_numpy().astype(np.int64)
            upto = np.r_[0, np.cumsum(gain[batch.column("features").flatten().to_numpy()])]
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(upto[ends] - upto[ends - lengths]), pa.array(lengths)], names=[*keep, "gain", "n"])

    rows = features.select(*keep, "features")
    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in rows.dtypes[:-1]) + ", gain bigint, n bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, grams: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null unless drawn) of every row of docs."""
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = stored(base.select("doc_id", F.monotonically_increasing_id().alias("place"), F.transform(lines, digest).alias("lines"), *(["text"] if grams > 1 else [])), "rows")
    features = stored(line_features(base, grams, buckets), "features")
    wanted = target.select(text(target_col).alias("text"))
    wanted = [stored(line_features(wanted, grams, buckets), "target")] + ([crossing_features(wanted.withColumn("place", F.lit(0).cast("bigint")), grams, buckets)] if grams > 1 else [])
    crossing = stored(crossing_features(rows, grams, buckets), "crossing") if grams > 1 else None

    once = F.lit(1).cast("bigint")
    whole = bucket_counts(features, buckets) + (bucket_counts(crossing.withColumn("occurrences", once), buckets) if crossing else 0)
    gain = gains(whole, sum(bucket_counts(f if "occurrences" in f.columns else f.withColumn("occurrences", once), buckets) for f in wanted))

    by_line = stored(summed(features, gain, ["line", "occurrences", "words"]), "lines")
    parts = join_counted(rows.select("place", F.explode("lines").alias("line")), by_line, ["line"], "occurrences").select("place", "gain", "n", "words")
    if crossing:
        parts = parts.unionByName(summed(crossing, gain, ["place"]).withColumn("words", F.lit(0).cast("bigint")))
    sums = parts.groupBy("place").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"), F.sum("words").alias("words"))
    weighed = rows.select("doc_id", "place").join(sums, "place", "left").na.fill(0, ["gain", "n", "words"])
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(0)
    scored = stored(weighed.select("doc_id", "place", F.col("n").alias("n_features"), "words", weight.cast("bigint").alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return scored.join(drawn(scored.where(F.col("words") >= least_words), percent), "place", "left").select("doc_id", "n_features", "weight", "score", "rank")


def drawn(scored: DataFrame, percent: int) -> DataFrame:
    """(place, rank) of the highest scores. Scores are whole thousandths of a logarithm, so there are some ten thousands of
    different ones however many rows: how many rows lie above each is summed over these, and rows are put in order within a score."""
    counts = stored(scored.groupBy("score").agg(F.count("*").alias("rows")), "counts")
    draw = percent * (counts.agg(F.sum("rows")).first()[0] or 0) // 100
    above = counts.select("score", (F.sum("rows").over(Window.orderBy(F.desc("score"))) - F.col("rows")).alias("above")).where(F.col("above") < draw)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "place"))
    return scored.join(above, "score").select("place", (F.col("above") + place).cast("bigint").alias("rank")).where(F.col("rank") <= draw)
