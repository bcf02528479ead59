"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if not (_LOCAL and os.path.isdir(_LOCAL)):
        _LOCAL = tempfile.mkdtemp(prefix="rankloom-")
    return f"file://{_LOCAL}"


_LOCAL = ""


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._rankloom_path = path
    return out


def cut_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As cut(), but dealt by a key into buckets, so that a later join by the key moves its other side only."""
    spark = df.sparkSession
    n = partitions_for(spark)
    table = f"rankloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._rankloom_path, out._rankloom_table = path, table
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that cut() or cut_by() wrote, once nothing reads it any more."""
    path = getattr(df, "_rankloom_path", None)
    if table := getattr(df, "_rankloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _trim() -> None:
    """Give memory that nothing uses back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not the C library that has it.
        return


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, after which the worker keeps no memory that it doesn't use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _trim()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about `most` bytes of a column, one row at least."""
    for b in batches:
        n = b.num_rows
        size = b.column(b.schema.get_field_index(column)).nbytes if n else 0
        step = max(1, int(n * most / size)) if size > most else max(n, 1)
        for i in range(0, n, step):
            yield b.slice(i, step)


def packed(docs: DataFrame) -> Column:
    """All columns of a table as one struct `doc`, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def fresh(name: str, names: list[str]) -> str:
    """The name, drawn out until no column has it."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_held_out(doc_id: str = "doc_id"):
    """True for the fold that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


BINARY = pa.large_binary()
