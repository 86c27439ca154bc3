"""The numbered queries: each applies its operator to the whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.llm import divergence, exact_dedup, fingerprints, langid, media, minhash, mixing, packing, pii, resampling, sharding, suffix_dedup, toxicity
from stocktide.llm.common import read_documents, stored
from stocktide.llm.oracles import ORACLES


def _fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read_documents(spark, sf_dir)).drop("spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).withColumn("held_out", F.coalesce(_fold(4) == 2, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train_rows=_fold(5) != 0)
    scored = toxicity.accept(toxicity.score(docs.withColumn("held_out", F.coalesce(_fold(5) == 0, F.lit(False))), model, keep=("doc_id", "held_out")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read_documents(spark, sf_dir), words=4)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(media.payload_rows(read_documents(spark, sf_dir)), "media")
    keep = ("doc_id", "n_bytes")
    sequences = media.interleave(rows, keep=keep)
    found = media.resolve(sequences, media.media_store(rows), keep=keep).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", "media.*", "position", "caption")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = pii.detect(docs, pii.train(docs))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    order = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_documents(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_documents(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_fingerprints, op3_language_id, op4_toxicity, op5_minhash, op6_media, op7_mixing, op8_sharding, op9_pii, op10_packing, op11_exact_dedup, op12_divergence, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
