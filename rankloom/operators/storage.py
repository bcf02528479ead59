"""Changes of a collection: documents are replaced, updated in part or deleted; every change gives new tables.

A change is declared on DataFrames and becomes durable when the tables are written as a snapshot; readers switch to it
when the pointer file is replaced.  Nothing is collected; keys of what goes are counted.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.corpus import Corpus

TABLES = ("docs", "postings", "forward", "structures", "metadata", "attributes", "acl")
#: Least and greatest values of metadata types, and their Spark types (fixed values).
TYPES = {
    "int8": (-128, 127, "tinyint"),
    "uint8": (0, 255, "smallint"),
    "int16": (-32768, 32767, "smallint"),
    "uint16": (0, 65535, "int"),
    "int32": (-2147483648, 2147483647, "int"),
    "uint32": (0, 4294967295, "bigint"),
    "float16": (None, None, "float"),
    "float32": (None, None, "float"),
}


def stored(value: Column, kind: str) -> Column:
    """A value as a metadata type keeps it: clamped to its range; a missing one is 0."""
    low, high, spark_type = TYPES[kind.lower()]
    v = F.coalesce(value, F.lit(0))
    if low is not None:
        v = F.least(F.greatest(v.cast("decimal(20,0)"), F.lit(low)), F.lit(high))
    return v.cast(spark_type)


def few(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Keys of what goes: up to so many are sent to the tables, and no row of a table is moved; more are joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def _without(corpus: Corpus, gone: DataFrame, tables=TABLES) -> Corpus:
    gone = few(gone)
    change = {t: getattr(corpus, t).join(gone, "docno", "left_anti").select(*getattr(corpus, t).columns) for t in tables if getattr(corpus, t) is not None}
    return dataclasses.replace(corpus, **change, _df={})


def delete(corpus: Corpus, docids: DataFrame) -> Corpus:
    """Without the documents of the ids (column docid); unknown ids change nothing."""
    return _without(corpus, corpus.docs.join(docids.select("docid").distinct(), "docid", "left_semi").select("docno"))


def replace(corpus: Corpus, new: Corpus) -> Corpus:
    """Documents of `new` take the place of those with the same id, as a whole; others are added.

    New documents keep their numbers only where no other document has them; ids that exist keep the old number."""
    old = corpus.docs.select(F.col("docno").alias("_old"), "docid")
    top = corpus.docs.agg(F.coalesce(F.max("docno"), F.lit(0)).alias("_top"))
    numbers = new.docs.join(old, "docid", "left").crossJoin(F.broadcast(top)).select(F.col("docno").alias("_new"), F.coalesce("_old", F.col("_top") + F.col("docno")).alias("_docno"))
    kept = delete(corpus, new.docs.select("docid"))
    out = {}
    for t in TABLES:
        mine, theirs = getattr(kept, t), getattr(new, t)
        if mine is None or theirs is None:
            continue
        moved = theirs.join(numbers, theirs["docno"] == numbers["_new"]).drop("docno", "_new").withColumnRenamed("_docno", "docno")
        out[t] = mine.unionByName(moved.select(*mine.columns))
    return dataclasses.replace(kept, **out, _df={})


def update(corpus: Corpus, part: Corpus | None = None, clear_terms: list[tuple[int, str]] | DataFrame = (), clear_forward: list[tuple[int, str]] | DataFrame = (), clear_attributes: list[tuple[int, str]] | DataFrame = ()) -> Corpus:
    """A partial update: (docno, type) pairs that `part` brings, or that are cleared, lose what they had.

    A document that is updated but brings no row of a type keeps its old ones, unless that pair is cleared."""
    spark = corpus.spark

    def cleared(table: str, column: str, pairs) -> DataFrame | None:
        if isinstance(pairs, DataFrame):
            gone = pairs.select(F.col(pairs.columns[0]).cast("long").alias("docno"), F.lower(pairs.columns[1]).alias(column))
        else:
            gone = spark.createDataFrame([(int(a), b.lower()) for a, b in pairs], f"docno long, {column} string") if pairs else None
        if part is not None and getattr(part, table) is not None:
            own = getattr(part, table).select("docno", column).distinct()
            gone = own if gone is None else gone.unionByName(own)
        return gone

    out = {}
    for table, column, pairs in (("postings", "type", clear_terms), ("forward", "type", clear_forward), ("attributes", "name", clear_attributes), ("structures", "struct", ())):
        now, gone = getattr(corpus, table), cleared(table, column, pairs)
        if gone is not None:
            now = now.join(few(gone), ["docno", column], "left_anti").select(*now.columns)
        if part is not None and getattr(part, table) is not None:
            now = now.unionByName(getattr(part, table).select(*now.columns))
        out[table] = now
    return dataclasses.replace(corpus, **out, _df={})


def delete_user(corpus: Corpus, username: str) -> Corpus:
    return dataclasses.replace(corpus, acl=corpus.acl.filter(F.col("username") != username))


def set_metadata(corpus: Corpus, values: DataFrame, name: str, kind: str = "int32") -> Corpus:
    """One metadata value of the documents in `values` (docno, value); the rest stays."""
    m = corpus.metadata.join(values.select("docno", F.col("value").alias("_v")), "docno", "left")
    changed = F.when(F.col("_v").isNotNull(), stored(F.col("_v"), kind)).otherwise(F.col(name))
    return dataclasses.replace(corpus, metadata=m.withColumn(name, changed).drop("_v"))


def set_attribute(corpus: Corpus, values: DataFrame, name: str) -> Corpus:
    """An attribute of the documents in `values` (docno, value); an empty value clears it."""
    rest = corpus.attributes.join(values.select("docno", F.lit(name.lower()).alias("name")), ["docno", "name"], "left_anti").select(*corpus.attributes.columns)
    new = values.filter("value <> ''").select("docno", F.lit(name.lower()).alias("name"), F.col("value").cast("string").alias("value"))
    return dataclasses.replace(corpus, attributes=rest.unionByName(new))


def alter_metadata(metadata: DataFrame, add: dict[str, str] = {}, alter: dict[str, tuple[str, str]] = {}, rename: dict[str, str] = {}, drop: list[str] = (), clear: bool = False) -> DataFrame:
    """A change of schema: new elements are 0; altered ones (name -> new name and type) are converted, clamped."""
    out = metadata.select("docno") if clear else metadata.drop(*drop)
    for old, (new, kind) in alter.items():
        out = out.withColumn(old, stored(F.col(old), kind)).withColumnRenamed(old, new)
    for old, new in rename.items():
        out = out.withColumnRenamed(old, new)
    for name, kind in add.items():
        out = out.withColumn(name, stored(F.lit(0), kind))
    return out


def term_statistics(corpus: Corpus, changes: DataFrame | None = None) -> DataFrame:
    """type, value, df: counted, plus explicit changes (type, value, increment); a negative sum is an error."""
    counted = corpus.postings.groupBy("type", "value").agg(F.countDistinct("docno").alias("df"))
    if changes is None:
        return counted
    both = counted.unionByName(changes.select("type", "value", F.col("increment").cast("bigint").alias("df")))
    total = both.groupBy("type", "value").agg(F.sum("df").alias("df"))
    return total.withColumn("df", F.when(F.col("df") < 0, F.raise_error(F.lit("a document frequency became negative")).cast("bigint")).otherwise(F.col("df")))


def differences(a: Corpus, b: Corpus, tables=("postings", "forward", "metadata", "attributes")) -> DataFrame:
    """A document checker: rows that only one of two collections has, per table and side; repeated rows count.

    Documents are compared by their number of rows and two sums of hashes (128 bits).  All rows of a document that one side
    lacks differ; only those of documents whose sums differ are compared as rows."""
    out = None
    for t in tables:
        x, y = getattr(a, t), getattr(b, t)
        columns = x.columns

        def sums(df: DataFrame, side: str) -> DataFrame:
            # Sums of half hashes are far from a long's bounds.
            halves = [f(F.xxhash64(F.lit(k), *columns)) for k in (1, 2) for f in (lambda h: h.bitwiseAND(0xFFFFFFFF), lambda h: F.shiftrightunsigned(h, 32))]
            return df.groupBy(F.col("docno").alias(f"{side}docno")).agg(F.count("*").alias(f"{side}n"), *[F.sum(h).alias(f"{side}{k}") for k, h in enumerate(halves)])

        other = " OR ".join(f"x{k} <> y{k}" for k in ("n", 0, 1, 2, 3))
        met = sums(x, "x").join(sums(y, "y"), F.col("xdocno").eqNullSafe(F.col("ydocno")), "full").filter(f"xn IS NULL OR yn IS NULL OR {other}")
        # One row for each document that differs: kept, since what follows depends on them and tables are read once.
        met = met.persist(StorageLevel.MEMORY_AND_DISK)
        both = met.agg(*[F.coalesce(F.sum(F.when(F.col(f"{o}n").isNull(), F.col(f"{s}n"))), F.lit(0)).alias(s) for s, o in ("xy", "yx")], F.lit(0).alias("in_x"), F.lit(0).alias("in_y"))
        unlike = met.filter(other).select(F.col("xdocno").alias("_d"))
        if unlike.limit(1).count():
            signed = [df.select(*columns).join(few(unlike), F.col("docno").eqNullSafe(F.col("_d")), "left_semi").select(*columns, F.lit(k).alias("_k")) for df, k in ((x, 1), (y, -1))]
            rest = signed[0].unionByName(signed[1]).groupBy(*columns).agg(F.sum("_k").alias("_k"))
            both = both.select("x", "y").crossJoin(rest.agg(*[F.coalesce(F.sum(F.greatest(F.col("_k") * k, F.lit(0))), F.lit(0)).alias(f"in_{s}") for s, k in (("x", 1), ("y", -1))]))
        sides = F.array(*[F.struct(F.lit(name).alias("only_in"), (F.col(s) + F.col(f"in_{s}")).alias("rows")) for s, name in (("x", "first"), ("y", "second"))])
        row = both.select(F.lit(t).alias("table"), F.explode(sides).alias("r")).select("table", "r.only_in", "r.rows")
        out = row if out is None else out.unionByName(row)
    return out


class Store:
    """Snapshots of a collection in a folder; a pointer file names the one that readers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/CURRENT"))

    def destroy(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def commit(self, corpus: Corpus) -> str:
        """Writes all tables, postings ordered by term so that statistics of row groups find a term, then moves the pointer."""
        name = f"snapshot-{uuid.uuid4().hex}"
        for t in TABLES:
            df = getattr(corpus, t)
            if df is None:
                continue
            if t == "postings":
                df = df.repartitionByRange("type", "value", "docno").sortWithinPartitions("type", "value", "docno", "pos")
            df.write.parquet(f"{self.path}/{name}/{t}")
        self._point(name)
        return name

    def _point(self, name: str) -> None:
        """Moves the pointer: a finished file is renamed over the old one, so readers see either snapshot, never none."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        new, current = self._path(f"{self.path}/.next-{uuid.uuid4().hex}"), self._path(f"{self.path}/CURRENT")
        out = self._fs.create(new)
        out.write(bytearray(name.encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, current, options)

    def open(self) -> Corpus:
        if not self.exists():
            raise FileNotFoundError(f"no collection in {self.path}")
        name = self.spark.read.text(f"{self.path}/CURRENT").first()[0]
        have = {t: f"{self.path}/{name}/{t}" for t in TABLES}
        return Corpus(**{t: self.spark.read.parquet(p) for t, p in have.items() if self._fs.exists(self._path(p))}, **({} if self._fs.exists(self._path(have["acl"])) else {"acl": None}))

    def backup(self, to: str) -> str:
        return Store(self.spark, to).commit(self.open())
