"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages and packing, one after the other.

Each stage is written as Parquet and read again before the next.  A stage works on all that the one before kept; its
models learn from the labels of the input folder, and from no row of the held-out fold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import _common, cotrain, near_copies, packing, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more as toxic go."""
    return toxicity.keep_clean(docs.select(*COLUMNS), toxicity.train(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of poor quality than not go."""
    return cotrain.keep_good(docs.select(*COLUMNS), cotrain.train(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their shingles of five words) the document with the least id stays: links of
    the SimHash trie join, checked by their shingles, then those beyond its budget of bits."""
    return near_copies.keep_first(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start anywhere else go; documents stay."""
    return suffix_dedup.strip(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 2048 tokens."""
    found = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: Classifiers, connected components and packing have no SQL form.  The tests compare every stage with a plain version of it,
#: over all that the stage before kept of the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = _common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
