"""Corpus pipeline: documents -> toxicity filter -> near-dedup -> PII redaction -> source mixing -> packed sequences.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents; the last
returns a row per packed piece. Rows with nulls, empty and repeated rows follow the rules of the operators; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktide.llm import minhash, mixing, packing, pii, toxicity
from stocktide.llm.common import read_documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on the labelled ones among them, doesn't predict to be toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accept(toxicity.score(docs, model, keep=COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies. Rows equal in id and text are one; different texts under one id are documents of
    their own: the first real one goes by the id, the others by a number that a hash of id and text gives, above usual ids."""
    with_id = docs.where("doc_id is not null")
    # Only ids are shuffled to find the repeated ones; tables of known size are broadcast if they are small.
    ids = stored(with_id.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    first = F.min("text").over(Window.partitionBy("doc_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars"))
    other = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    key = F.when(F.col("text").eqNullSafe(F.col("_first")), F.col("doc_id")).otherwise(other)
    repeated = with_id.join(ids, "doc_id").withColumn("_first", first).withColumn("_nth", nth).where("_nth = 1").withColumn("_key", key)
    rows = with_id.join(ids, "doc_id", "left_anti").withColumn("_key", F.col("doc_id")).select("_key", *COLUMNS).unionAll(repeated.select("_key", *COLUMNS))
    gone = stored(minhash.near_groups(rows, id_col="_key").where("not kept").select(F.col("doc_id").alias("_key")).distinct(), "copies")
    return rows.join(gone, "_key", "left_anti").select(*COLUMNS).unionAll(docs.where("doc_id is null").select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    found = pii.detect(docs, pii.train(docs), keep=("doc_id", "lang", "source", "n_chars"), redact=True)
    n_chars = F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.char_length("redacted")).cast("bigint")
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix uses them, at least once each."""
    return mixing.mix(docs, keep=COLUMNS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]
#: Models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
