"""Loaders of line-based value files and of word vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.sources.corpus import Corpus


def assignments(spark: SparkSession, path: str, corpus: Corpus, key: str | None = None) -> DataFrame:
    """(docno, value) of lines `<key> <value>`.

    The key is an attribute's value if `key` names one; else a document id, or a number (digits, or _ and digits).
    Unknown keys are skipped; of several lines for a document the last of the file counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", r"^\s*(\S+)\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("value", r"^\s*(\S+)\s*(.*?)\s*$", 2).alias("value")).filter("key <> ''")
    if key:
        known = corpus.attributes.filter(F.col("name") == key.lower()).select(F.col("value").alias("key"), "docno")
        rows = lines.join(known, "key")
    else:
        number = F.regexp_extract("key", r"^_?(\d+)$", 1)
        rows = lines.join(corpus.docs.select(F.col("docid").alias("key"), "docno"), "key", "left").select("line", "value", F.coalesce("docno", F.when(number != "", number.cast("bigint"))).alias("docno")).join(corpus.docs.select("docno"), "docno", "left_semi")
    return rows.groupBy("docno").agg(F.max_by("value", "line").alias("value"))


def user_rights(spark: SparkSession, path: str, corpus: Corpus) -> DataFrame:
    """The access table after lines `<docid> [+|-]user,...`; a bare - clears all rights of the document so far."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 1).alias("docid"), F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)\s*$", 2).alias("rights")).filter("docid <> ''")
    steps = lines.join(corpus.docs, "docid").select("docno", "line", F.posexplode(F.split("rights", r"\s*,\s*")).alias("k", "right"))
    clear = F.col("right") == "-"
    w = Window.partitionBy("docno")
    order = F.struct("line", "k")
    last_clear = F.max(F.when(clear, order)).over(w)
    live = steps.withColumn("c", last_clear)
    cleared = live.filter("c IS NOT NULL").select("docno").distinct()
    after = live.filter(~clear & (F.col("c").isNull() | (order > F.col("c"))))
    final = after.select("docno", F.regexp_replace("right", "^[+-]", "").alias("username"), order.alias("o"), (~F.col("right").startswith("-")).alias("give")).groupBy("docno", "username").agg(F.max_by("give", "o").alias("give"))
    before = corpus.acl.join(cleared, "docno", "left_anti").join(final.select("docno", "username"), ["docno", "username"], "left_anti")
    return before.select("username", "docno").unionByName(final.filter("give").select("username", "docno"))


def vectors_text(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """type, feature, vec of a word2vec text file; a first line of two numbers is its head."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*\d+\s+\d+\s*$") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return _typed(lines.select(parts[0].alias("name"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vec")), separator)


def _typed(df: DataFrame, separator: str | None) -> DataFrame:
    if not separator:
        return df.select(F.lit("").alias("type"), F.col("name").alias("feature"), "vec")
    at = F.instr("name", separator)
    return df.select(F.when(at > 0, F.substring_index("name", separator, 1)).otherwise("").alias("type"), F.when(at > 0, F.expr(f"substring(name, instr(name, '{separator}') + {len(separator)})")).otherwise(F.col("name")).alias("feature"), "vec")


def parse_binary(data: bytes, big_endian: bool = False) -> Iterator[tuple[str, list[float]]]:
    head, _, rest = data.partition(b"\n")
    count, size = map(int, head.split())
    at = 0
    for _ in range(count):
        end = rest.index(b" ", at)
        name = rest[at:end].decode().strip()
        vec = struct.unpack_from(f"{'>' if big_endian else '<'}{size}f", rest, end + 1)
        at = end + 1 + 4 * size
        while rest[at : at + 1] in (b"\n", b"\r"):
            at += 1
        yield name, list(vec)


def vectors_binary(spark: SparkSession, path: str, separator: str | None = None, big_endian: bool = False) -> DataFrame:
    """The same of word2vec binary files, one task per file."""

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                rows = list(parse_binary(bytes(data), big_endian))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=["name", "vec"])

    return _typed(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, vec array<float>"), separator)
