"""A document collection as DataFrames: postings, forward text, structures, metadata, attributes and access rights.

Tables (docno starts at 1):
    docs       docno, docid
    postings   type, value, docno, pos, len          unique on (type, value, docno, pos)
    forward    docno, type, pos, value
    structures docno, struct, struct_index, hstart, hend, cstart, cend, level
    metadata   docno and declared numeric columns    a missing value reads as 0
    attributes docno, name, value
    acl        username, docno
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+|[.!?]"
DELIMITERS = (".", "!", "?")
#: Collections whose documents take up to so many bytes as files keep their tables in a session.
KEPT_BYTES = 32 << 20
#: The key under which the number of documents is remembered.
COUNT = ("#documents", "")


@dataclass
class Corpus:
    docs: DataFrame
    postings: DataFrame
    forward: DataFrame
    structures: DataFrame
    metadata: DataFrame
    attributes: DataFrame
    acl: DataFrame | None = None
    #: (type, value) -> document frequency, and the number of documents, where a client gives them.
    client_df: dict[tuple[str, str], int] = field(default_factory=dict)
    client_n: int = -1
    #: What was counted, remembered; queries of a collection share it.
    _df: dict[tuple[str, str], int] = field(default_factory=dict)
    #: Where the tables are computed from texts: those tables, and what makes them from texts dealt by document.
    _texts: tuple[tuple[DataFrame, ...], Callable[[], "Corpus"]] | None = None
    #: Then also docno and text, as bytes, of the documents, and the metadata as they were built.
    _read: tuple[DataFrame, DataFrame] | None = None
    #: The collection that these are some documents of; statistics are those of the whole.
    _whole: "Corpus | None" = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def n_docs(self) -> int:
        if self._whole:
            return self._whole.n_docs()
        if self.client_n >= 0:
            return self.client_n
        if COUNT not in self._df:
            self._df[COUNT] = self.docs.count()
        return self._df[COUNT]

    def dfs(self, terms: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Document frequencies of a query's terms: one small aggregate, remembered."""
        if self._whole:
            return self._whole.dfs(terms)
        need = {t for t in terms if t not in self.client_df and t not in self._df}
        if need:
            # Types and values as they are stored reach the scan; their pairs are told apart after it.
            hit = self.postings.filter(F.col("type").isin(sorted({t for t, _ in need})) & F.col("value").isin(sorted({v for _, v in need})) & F.concat_ws("\x1f", "type", "value").isin([f"{t}\x1f{v}" for t, v in need]))
            got = {(r["type"], r["value"]): r["df"] for r in hit.groupBy("type", "value").agg(F.countDistinct("docno").alias("df")).collect()}
            self._df.update({t: got.get(t, 0) for t in need})
        return {t: self.client_df.get(t, self._df.get(t, 0)) for t in terms}

    def term(self, kind: str, value: str, length: int = 1) -> DataFrame:
        """Postings of one term as (docno, pos, len); an unknown term has none."""
        out = self.postings.filter((F.col("type") == kind.lower()) & (F.col("value") == value)).select("docno", "pos", F.lit(length).alias("len"))
        # Operators on several terms scan the postings once.
        out._rankloom_term = self.postings, kind.lower(), value, length
        return out

    def texts(self) -> DataFrame | None:
        """docno, a key, and text, as bytes, of the documents, where postings, forward text and structures are computed from them."""
        if self._texts and all(a is b for a, b in zip(self._texts[0], (self.postings, self.forward, self.structures))):
            return self._read[0]
        return None

    def built_metadata(self) -> DataFrame | None:
        return self._read[1] if self._read else None

    def dealt(self) -> "Corpus":
        """The same tables for plans that group or join all rows by document: computed from texts that were dealt by docno, so
        that only texts are moved and no row of a token.  Tables that were changed, kept or read from elsewhere stay as they are."""
        if self.texts() is not None:
            return dataclasses.replace(self._texts[1](), client_df=self.client_df, client_n=self.client_n, acl=self.acl, attributes=self.attributes, docs=self.docs, metadata=self.metadata, _df=self._df)
        return self

    def of_documents(self, docnos: list[int]) -> "Corpus":
        """The rows of a few documents; the numbers are literals, so that they reach the scans of texts or snapshots."""
        only = lambda t: None if t is None else t.filter(F.col("docno").isin(docnos))
        cut = {t: only(getattr(self, t)) for t in ("docs", "postings", "forward", "structures", "metadata", "attributes", "acl")}
        return dataclasses.replace(self, **cut, _texts=None, _whole=self._whole or self)

    def persist(self) -> "Corpus":
        for name in ("postings", "metadata", "docs", "forward", "structures"):
            setattr(self, name, getattr(self, name).persist(StorageLevel.MEMORY_AND_DISK))
        self._texts = None
        return self


def tokens(documents: DataFrame) -> DataFrame:
    """docno, pos and t of documents with docno and text."""
    return documents.select("docno", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))).alias("p", "t")).select("docno", (F.col("p") + 1).alias("pos"), "t")


def build(documents: DataFrame, labels: DataFrame) -> Corpus:
    """The tables of a collection that has doc_id, text, lang, source, n_chars, and labels with doc_id, quality, toxic.

    Types are literals of their branch, so that a plan that asks for one type computes no other."""
    d = documents.select((F.col("doc_id") + 1).alias("docno"), "lang", "source", "n_chars", "text")
    count = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    lab = labels.groupBy((F.col("doc_id") + 1).alias("docno")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    metadata = d.select("docno", count.alias("doclen"), "n_chars").join(lab, "docno", "left").select("docno", F.col("doclen").cast("bigint"), F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce("quality", F.lit(0)).cast("int").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"))
    docs = d.select("docno", F.concat(F.lit("D"), (F.col("docno") - 1).cast("string")).alias("docid"))
    attributes = documents.select((F.col("doc_id") + 1).alias("docno"), F.explode(F.create_map(F.lit("docid"), F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.lit("lang"), "lang", F.lit("source"), "source")).alias("name", "value")).filter("value IS NOT NULL")
    acl = d.select(F.col("source").alias("username"), "docno").filter("username IS NOT NULL")

    def made(d: DataFrame) -> Corpus:
        t = tokens(d)
        word = ~F.col("t").isin(*DELIMITERS)
        postings = t.select(F.when(word, "word").otherwise("eos").alias("type"), F.when(word, F.lower("t")).otherwise("").alias("value"), "docno", "pos", F.lit(1).alias("len"))
        for kind in ("lang", "source"):
            postings = postings.unionByName(d.filter(F.col(kind).isNotNull()).select(F.lit(kind).alias("type"), F.col(kind).alias("value"), "docno", F.lit(1).alias("pos"), F.lit(1).alias("len")))
        tag = F.when(~word, "P").when(F.col("t").rlike("^[0-9]+$"), "N").otherwise("W")
        forward = t.select("docno", "pos", F.lit("orig").alias("type"), F.col("t").alias("value")).unionByName(t.select("docno", "pos", F.lit("tag").alias("type"), tag.alias("value")))
        return Corpus(docs, postings, forward, structures(d), metadata, attributes, acl)

    c = made(d)
    c._texts = (c.postings, c.forward, c.structures), lambda: made(d.repartition("docno"))
    c._read = d.select("docno", F.col("text").cast("binary").alias("text")), metadata
    return c


def structures(d: DataFrame) -> DataFrame:
    """title: header up to the first delimiter, content the rest; sentence: header and content are the sentence.

    Made inside each document's row, from the places of its delimiters and the place after its end."""
    found = F.regexp_extract_all(F.concat(F.coalesce("text", F.lit("")), F.lit(".")), F.lit(TOKEN), F.lit(0))
    ends = F.filter(F.transform(found, lambda t, i: F.when(t.isin(*DELIMITERS), i + 1)), lambda x: x.isNotNull())

    def field(struct: str, index: Column, hs: Column, he: Column, cs: Column, ce: Column, level: int) -> Column:
        return F.struct(F.lit(struct).alias("struct"), index.cast("int").alias("struct_index"), hs.cast("int").alias("hstart"), he.cast("int").alias("hend"), cs.cast("int").alias("cstart"), ce.cast("int").alias("cend"), F.lit(level).alias("level"))

    def fields(e: Column) -> Column:
        first, after = F.element_at(e, 1), F.element_at(e, -1)
        title = F.when((F.size(e) > 1) & (first > 1), F.array(field("title", F.lit(1), F.lit(1), first, first, after, 0)))
        runs = F.filter(F.zip_with(F.concat(F.array(F.lit(0)), e), e, lambda a, b: F.struct((a + 1).alias("a"), b.alias("b"))), lambda r: r["a"] < r["b"])
        sentences = F.transform(runs, lambda r, i: field("sentence", i + 1, r["a"], r["b"], r["a"], r["b"], 1))
        return F.concat(F.coalesce(title, F.slice(sentences, 1, 0)), sentences)

    # A lambda's argument is computed once, however often its body names it.
    made = F.flatten(F.transform(F.array(ends), fields))
    return d.select("docno", F.explode(made).alias("f")).select("docno", "f.*")


_BUILT: dict[tuple[str, str], Corpus] = {}


def from_tables(spark: SparkSession, sf_dir: str) -> Corpus:
    """The collection of a folder of tables.  That of a small one is built once a session and kept.  Tables of a larger one
    take many times its texts' size and are computed from the texts where a plan asks for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        documents = read("documents")
        built = build(documents, read("labels"))
        size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        _BUILT[key] = built.persist() if size <= KEPT_BYTES else built
    return _BUILT[key]
