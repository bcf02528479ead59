"""The queries of the training-data operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import _common, bpe, cotrain, fingerprints, licences, packing, simhash, suffix_dedup, tiff, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_common.documents(spark, sf_dir), words=4, errors=4, seed=42)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", warc.header_text(F.col("headers")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    scored = cotrain.score(docs, cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", _common.fold_held_out().alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_common.documents(spark, sf_dir))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.page_digests(tiff.text_pages(_common.documents(spark, sf_dir)))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_common.documents(spark, sf_dir)).filter("exact")
    return found.groupBy("doc_id", "licence").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _common.fold_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.token_pieces(_common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_common.documents(spark, sf_dir), length=200)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_warc, op3_quality, op4_fingerprints, op5_tiff, op6_licences, op7_toxicity, op8_packing, op9_suffix_dedup, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op6_licences": licences.ORACLE}
