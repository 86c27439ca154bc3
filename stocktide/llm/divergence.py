"""How far the sources of a language lie apart, in the terms they use.

Strings are materialised late. Tasks count the terms of their own documents and leave the counts, with the strings, in a stored table of
which the counting shuffles read the fixed-width digests only: a term goes by its 64-bit digest until the results are known. For the
digests that enough documents hold, the smallest and the largest string are compared: where they differ, several terms share a digest, and
only these are split, by string, and counted anew. At the end text is joined back to the terms that a report keeps.

A kept term's share in a group of documents is p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), where N counts all V kept terms of the
language in the group. `pair` compares a source with each other one by the sum of |p - q| over all kept terms; `term` ranks
the terms that a source uses more than its language does.

Cases: null text, language and source are ''; a document without terms still makes its group known; ties in value go by the item's
UTF-8 bytes; repeated rows are documents of their own; a very long text is one document; a language without kept terms has
pairs of value 0; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.llm.common import discard, slices, small_batches, stored

TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE, PRIOR = 1_000_000_000, 5
BLOCK_ROWS, BLOCK_TERMS = 1 << 21, 500_000  # counts and different terms that a task holds before it hands them out
SLICE = 1 << 16
CELLS = 1 << 15  # of a block's matrix of terms by sources
COUNTS = "lang string, source string, digest bigint, term string, n bigint, docs bigint"


class _Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, thing) -> int:
        found = self[thing] = len(self)
        return found


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return [key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values)]


def term_counts(docs: DataFrame, bits: int = 64, named: bool = False) -> DataFrame:
    """Per task and block: occurrences of each term of a group and documents that hold it, by digest; and a row with the digest and the
    string of each term, but for these null. With `named` counts have the string, too. Terms are maximal runs of letters and of characters
    beyond ASCII, A-Z lower-cased (bytes.lower leaves all others alone). Fewer bits of a digest make collisions, for tests."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, groups, held = _Numbers(), _Numbers(), []

        def block() -> Iterator[pa.RecordBatch]:
            key, n, in_docs = _summed(*(np.concatenate(x) for x in zip(*held)))
            strings = pa.array(list(terms), pa.binary()).cast(pa.string())
            digests = pa.array((np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms)) >> np.uint64(64 - bits)).view(np.int64))
            langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            group, term = pa.array(key >> 32), pa.array(key & 0xFFFFFFFF)
            none = pa.nulls(len(key), pa.string())
            columns = [langs.take(group), sources.take(group), digests.take(term), strings.take(term) if named else none, pa.array(n), pa.array(in_docs)]
            tables = [columns, [pa.nulls(len(terms), t) if t else x for t, x in ((pa.string(), None), (pa.string(), None), (None, digests), (None, strings), (pa.int64(), None), (pa.int64(), None))]]
            for table in tables:
                rows = pa.RecordBatch.from_arrays(table, names=["lang", "source", "digest", "term", "n", "docs"])
                yield from (rows.slice(k, SLICE) for k in range(0, rows.num_rows, SLICE))
            terms.clear()
            groups.clear()
            held.clear()

        size = 0
        for batch in batches:
            for part in slices([batch]):
                words = [TERM.findall(x.lower()) for x in part.column("text").to_pylist()]
                lengths = np.array([len(w) for w in words], np.int64)
                number = np.fromiter(map(terms.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
                doc_term, n = np.unique(np.repeat(np.arange(len(words)), lengths) << 32 | number, return_counts=True)
                group = np.fromiter(map(groups.__getitem__, zip(part.column("lang").to_pylist(), part.column("source").to_pylist())), np.int64, len(words))
                held.append(_summed(group[doc_term >> 32] << 32 | doc_term & 0xFFFFFFFF, n, np.ones(len(n), np.int64)))
                if sum(len(x[0]) for x in held) > 2 * size + BLOCK_ROWS // 4:
                    held[:] = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                if size > BLOCK_ROWS or len(terms) > BLOCK_TERMS:
                    yield from block()
                    size = 0
        if held:
            yield from block()

    small_batches(docs.sparkSession)
    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(blocks, COUNTS)


def share(n: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (whole + PRIOR * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + PRIOR), wide(whole) + PRIOR * wide(terms)) + 1


def kept_terms(rows: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(counts of kept terms by group and term, text of each term). A term is (digest, split): split is '' unless its digest has
    several strings, else the string."""
    counted = stored(term_counts(rows, bits), "counts")
    counts = counted.where("n is not null").drop("term")
    held = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest")
    held = stored(held, "held")  # of collided digests, too: together they are in as many documents as each of them
    texts = counted.where("n is null").select("digest", "term").join(held.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    texts = stored(texts, "texts")
    shared = texts.where("low <> high").select("digest")
    kept, fine = held.withColumn("split", F.lit("")), counts.withColumn("split", F.lit(""))
    if not shared.isEmpty():  # only these are counted again, by string
        again = term_counts(rows, bits, named=True).where("n is not null").join(shared, "digest", "left_semi").withColumnRenamed("term", "split")
        again = stored(again, "split")
        split = again.groupBy("lang", "digest", "split").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest", "split")
        kept, fine = kept.join(shared, "digest", "left_anti").unionByName(split), fine.join(shared, "digest", "left_anti").unionByName(again)
    by_group = fine.groupBy("lang", "source", "digest", "split").agg(F.sum("n").alias("n")).join(kept, ["lang", "digest", "split"], "left_semi")
    by_group = stored(by_group, "terms")
    discard(counted)
    return by_group, texts


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| of every two sources over the terms of a block."""
    right = right.sort_values("source", ignore_index=True)
    sources = right["source"].to_numpy()
    term = left.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
    p = np.tile(right["without"].to_numpy(np.int64), (term.max() + 1 if len(term) else 0, 1))
    p[term, np.searchsorted(sources, left["source"].to_numpy())] = left["p"].to_numpy(np.int64)
    sums = np.array([np.abs(p - p[:, [k]]).sum(0) for k in range(len(sources))], np.int64).reshape(len(sources), len(sources))
    a, b = np.nonzero(sums)
    return pd.DataFrame({"lang": right["lang"].iat[0] if len(right) else None, "source": sources[a], "item": sources[b], "value": sums[a, b]})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    terms, texts = kept_terms(rows, least_docs, bits)

    # A row for each group or language.
    whole = terms.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    of_lang = terms.groupBy("lang").agg(F.count_distinct("digest", "split").alias("terms"), F.sum("n").alias("lang_whole"))
    groups = rows.select("lang", "source").distinct().join(whole, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["whole", "terms", "lang_whole"])
    groups = stored(groups.withColumn("without", F.when(F.col("terms") > 0, share(F.lit(0), F.col("whole"), F.col("terms")))), "groups")
    shares = terms.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole"), F.col("terms")))
    in_lang = terms.groupBy("lang", "digest", "split").agg(F.sum("n").alias("lang_n"))

    value = F.col("p") - share(F.col("lang_n"), F.col("lang_whole"), F.col("terms"))
    above = shares.join(in_lang, ["lang", "digest", "split"]).withColumn("value", value).where("value > 0")
    of_group = Window.partitionBy("lang", "source")
    # Ties at the end of the list go along until their texts are there to decide.
    near = above.select("lang", "source", "digest", "split", "value", F.rank().over(of_group.orderBy(F.desc("value"))).alias("place")).where(F.col("place") <= top)
    named = near.join(texts, "digest").withColumn("item", F.when(F.col("split") != "", F.col("split")).otherwise(F.col("low")))
    ordered = of_group.orderBy(F.desc("value"), "item")
    by_term = named.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank")).where(F.col("rank") <= top)

    sources = F.count("*").over(Window.partitionBy("lang"))
    sized = groups.where("terms > 0").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * sources / CELLS)).cast("int"))
    every = sized.select("lang", "source", "without", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = sized.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    dealt = shares.select("lang", "source", "digest", "split", "p").join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("digest", "split"), F.col("blocks")).cast("int")).drop("blocks")
    parts = dealt.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(_distances, "lang string, source string, item string, value bigint")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the rows of the result
    pairs = others.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))
    return by_pair.unionByName(by_term)
