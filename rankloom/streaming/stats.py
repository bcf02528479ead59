"""Collection statistics as changes that add up: in batch, as a stream, and merged over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.corpus import Corpus

SCHEMA = "ts timestamp, node string, type string, value string, increment long"
#: The type of rows that change the number of documents.
DOCUMENTS = "#documents"


def changes(corpus: Corpus, node: DataFrame | None = None) -> DataFrame:
    """One row per node, type and value with the number of its documents, and one per node with its documents."""
    nodes = node if node is not None else corpus.acl.select("docno", F.col("username").alias("node"))
    # Dealt by document once: neither the distinct terms of a document nor their nodes move a row of a term again.
    per_term = corpus.dealt().postings.select("docno", "type", "value").distinct().join(nodes.hint("shuffle_hash"), "docno").groupBy("node", "type", "value").agg(F.count("*").alias("increment"))
    per_node = corpus.docs.join(nodes, "docno").groupBy("node").agg(F.count("*").alias("increment")).select("node", F.lit(DOCUMENTS).alias("type"), F.lit("").alias("value"), "increment")
    return per_term.unionByName(per_node)


def statistics(rows: DataFrame) -> DataFrame:
    """df of each (type, value): the sum of increments; works on streams as well."""
    return rows.groupBy("type", "value").agg(F.sum("increment").alias("df"))


def since(rows: DataFrame, ts) -> DataFrame:
    return rows.filter(F.col("ts") > F.lit(ts))


def timestamps(rows: DataFrame) -> DataFrame:
    return rows.select("ts").distinct().orderBy("ts")


def stream(spark: SparkSession, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Sums up all change files of a folder, and those that arrive, into the in-memory table `name`.

    Increments commute, so late rows need no watermark; state is one number per term."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    return statistics(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge(results: list[DataFrame], min_rank: int = 0, max_ranks: int = 20) -> DataFrame:
    """The best of several rank lists (docno, weight), with a real offset."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    order = [F.round("weight", 9).desc(), F.col("docno").desc()]
    return out.orderBy(*order).offset(min_rank).limit(max_ranks)


def merge_summaries(summaries: list[DataFrame]) -> DataFrame:
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("name", "value").agg(F.sum("weight").alias("weight"))
