"""Threshold-scaled document fingerprints, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document's, sketches of parts
merge by union, and shared hashes estimate both similarity and containment of very unequal documents. A text whose
hashes all lie above keeps its smallest one, so that only texts without words have empty sketches.

Cases: a null text is empty; a text of fewer words than a shingle is one shingle; two empty sketches are alike if
both have no shingle (1.0), an empty and a filled one aren't (0.0); null ids come first in the order of
documents, rows that share an id are ordered by text; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
FRACTION = 0.25
BUCKET_BYTES = 4 << 20
SAMPLES_PER_BUCKET = 16
MAX_BUCKETS = 1 << 16  # bounds what the driver samples and broadcasts; larger ranges are sorted with spilling
LOWEST = -(1 << 63)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes, as array<bigint>."""
    limit = F.lit(LOWEST + int(fraction * (1 << 64)) - 1)
    terms = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = _let(terms, lambda t: F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - (words - 1))), lambda i: F.xxhash64(F.slice(t, i, words)))))
    kept = _let(hashes, lambda h: _let(F.filter(h, lambda x: x <= limit), lambda low: F.when((F.size(low) > 0) | (F.size(h) == 0), low).otherwise(F.array(F.array_min(h)))))
    return F.sort_array(F.array_distinct(kept))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two sketches, 0 to 1."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of both texts' shingles together; a smallest hash that stood in for none is kept only if no other is left."""
    limit = F.lit(LOWEST + int(fraction * (1 << 64)) - 1)
    return F.sort_array(_let(F.array_union(a, b), lambda u: _let(F.filter(u, lambda h: h <= limit), lambda low: F.when((F.size(low) > 0) | (F.size(u) == 0), low).otherwise(F.array(F.array_min(u))))))


def written(s: Column) -> Column:
    """16 hex digits a hash, in order."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _bounds(docs: DataFrame) -> tuple[list[int], bool]:
    """Ids that start the buckets (the smallest one first), and whether there are null ids."""
    n, size, low, nulls = docs.agg(F.count("*"), F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if low is None:
        return [], bool(nulls)
    buckets = min(n, (size or 0) // BUCKET_BYTES + 1, MAX_BUCKETS)
    step = max(1, n // (buckets * SAMPLES_PER_BUCKET))
    sample = sorted(r["doc_id"] for r in docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)).select("doc_id").distinct().collect())
    return sorted({low, *sample[:: max(1, len(sample) // buckets)]}), bool(nulls)


def with_next(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each row with `next_text` and a `next_` column for each of `extra`, taken from the row that follows by id (after the last: the first).

    Rows are dealt to ranges of ids that start at sampled ids; the first row of a range is also dealt, as a guest, to the
    range before it, so that every range finds its neighbours by itself. A range is found in two steps over about the square root of
    their number, wherever the ids lie.
    """
    bounds, nulls = _bounds(docs)
    width = max(1, math.isqrt(len(bounds)))
    outer = F.array(*[F.lit(b) for b in bounds[::width]]).cast("array<bigint>")
    table = [(k // width + 1, k, bounds[k : k + width]) for k in range(0, max(1, len(bounds)), width)]
    # A row for every `width` ranges, MAX_BUCKETS ids in all at most.
    lookup = F.broadcast(docs.sparkSession.createDataFrame(table, "cell int, base int, inside array<bigint>"))
    dealt = docs.withColumn("cell", F.greatest(F.lit(1), F.size(F.filter(outer, lambda b: b <= F.col("doc_id"))))).join(lookup, "cell")
    last = max(1, len(bounds))
    bucket = F.when(F.col("doc_id").isNull(), 1).otherwise(F.greatest(F.lit(1), F.col("base") + F.size(F.filter("inside", lambda b: b <= F.col("doc_id")))))
    starts = F.array_contains("inside", F.col("doc_id"))
    opens = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(bounds[0] if bounds else None)
    dealt = dealt.withColumn("bucket", bucket).withColumn(
        "place",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")),
                    F.when(F.col("doc_id").isNotNull() & starts & (F.col("bucket") > 1), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("guest"))),
                    F.when(opens, F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("guest"))),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    order = Window.partitionBy("place.bucket").orderBy("place.guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *extra)]
    return dealt.select("doc_id", "text", *extra, F.col("place.guest").alias("guest"), *following).where("guest = 0").drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    both = with_next(rows, ("sketch",)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = both.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return both.select("doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
