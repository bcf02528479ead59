"""Readers over a collection's tables: scans of terms, documents, structures, dictionaries and statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.plans import restrict
from rankloom.sources.corpus import DELIMITERS, TOKEN, Corpus


def frequency_postings(corpus: Corpus, kind: str, value: str) -> DataFrame:
    """docno and ff of a term, without positions."""
    return corpus.term(kind, value).groupBy("docno").agg(F.count("*").alias("ff"))


def null_postings(corpus: Corpus) -> DataFrame:
    return corpus.postings.select("docno", "pos", "len").limit(0)


def browse(corpus: Corpus, compares: list[restrict.Compare], max_pos: int = 1) -> DataFrame:
    """All (docno, pos) with pos up to max_pos of documents whose metadata pass."""
    return corpus.metadata.filter(restrict.column(compares)).select("docno", F.explode(F.sequence(F.lit(1), F.lit(max_pos))).alias("pos"), F.lit(1).alias("len"))


def forward_values(corpus: Corpus, kind: str) -> DataFrame:
    return corpus.forward.filter(F.col("type") == kind.lower()).select("docno", "pos", "value")


#: Terms that this many documents hold bring their frequency along in a small table; about so many terms at most.
COMMON_TERMS = 200_000
#: Rows that leave a task's Python at once, if no document has more.
BATCH_ROWS = 50_000


def document_terms(corpus: Corpus, kind: str) -> DataFrame:
    """docno, value, ff, firstpos and the term's document frequency.

    Frequencies of the commonest terms are sent to the rows; only rows of the others are dealt by their term.  Words of texts
    are counted in their document's row, so that no token is a row."""
    kind = kind.lower()
    texts = corpus.texts()
    if kind == "word" and texts is not None:
        # Words take a byte each, and one between them.
        rows = (texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // 2
        dfs = texts.mapInArrow(_held, "value string, n long").groupBy("value").agg(F.sum("n").alias("df"))
        common = {r["value"].encode(): r["df"] for r in dfs.filter(F.col("df") > F.lit(rows // COMMON_TERMS)).toLocalIterator()}
        schema = "docno long, value string, ff long, firstpos int, df long"
        many, few = (texts.mapInArrow(_counted(common, c), schema) for c in (True, False))
        # What is left of a term is in so few documents that a window holds them.
        return many.unionByName(few.drop("df").withColumn("df", F.count("*").over(Window.partitionBy("value"))))
    per_doc = corpus.dealt().postings.filter(F.col("type") == kind).groupBy("docno", "value").agg(F.count("*").alias("ff"), F.min("pos").alias("firstpos"))
    dfs = per_doc.groupBy("value").agg(F.count("*").alias("df"))
    # The n-th commonest term is in at most (rows / n) documents, so a least frequency bounds the number of terms.
    rows = corpus.postings.filter(F.col("type") == kind).count()
    common = F.broadcast(dfs.filter(F.col("df") > F.lit(rows // COMMON_TERMS)).select(F.col("value").alias("_v"), F.col("df").alias("_df")))
    met = per_doc.join(common, F.col("value") == F.col("_v"), "left").select("docno", "value", "ff", "firstpos", "_df")
    many = met.filter("_df IS NOT NULL").withColumnRenamed("_df", "df")
    return many.unionByName(met.filter("_df IS NULL").drop("_df").join(dfs, "value").select("docno", "value", "ff", "firstpos", "df"))


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    """The tokens of each text in lower case, which is ASCII's as they are."""
    token = re.compile(TOKEN.encode())
    for text in texts:
        yield token.findall((text.as_py() or b"").lower())


def _counted(dfs: dict[bytes, int], known: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """docno, value, ff, firstpos and df of the words of each text whose frequencies are known, or of the others without it."""
    schema = pa.schema([("docno", pa.int64()), ("value", pa.string()), ("ff", pa.int64()), ("firstpos", pa.int32()), ("df", pa.int64())])
    ends = [t.encode() for t in DELIMITERS]

    def made(docnos: list, lengths: list, values: list, ff: list, first: list) -> pa.RecordBatch:
        docno = pa.array(np.repeat(np.array(docnos, dtype=np.int64), lengths))
        df = pa.array(map(dfs.__getitem__, values), pa.int64()) if known else pa.nulls(len(values), pa.int64())
        return pa.record_batch([docno, pa.array(values, pa.binary()).cast(pa.string()), pa.array(ff, pa.int64()), pa.array(first, pa.int32()), df], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = [], [], [], [], []
        for batch in batches:
            for docno, tokens in zip(batch.column(0).to_pylist(), _words(batch.column(1))):
                count = Counter(tokens)
                for t in ends:
                    count.pop(t, None)
                mine = [t for t in count if (t in dfs) is known]
                # The last place that is put stays: the first.
                at = dict(zip(reversed(tokens), range(len(tokens), 0, -1))) if mine else {}
                for to, x in zip(out, ([docno], [len(mine)], mine, map(count.__getitem__, mine), map(at.__getitem__, mine))):
                    to += x
                if len(out[2]) >= BATCH_ROWS:
                    yield made(*out)
                    out = [], [], [], [], []
        if out[2]:
            yield made(*out)

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how many of some texts hold them."""
    schema = pa.schema([("value", pa.string()), ("n", pa.int64())])
    ends = {t.encode() for t in DELIMITERS}

    def made(n: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], schema=schema)

    n: Counter = Counter()
    for batch in batches:
        for tokens in _words(batch.column(1)):
            n.update(set(tokens) - ends)
            if len(n) >= BATCH_ROWS:
                yield made(n)
                n = Counter()
    if n:
        yield made(n)


def structure_at(corpus: Corpus, points: DataFrame, level: int = 0) -> DataFrame:
    """For each (docno, pos) the first field of the level that ends after it."""
    fields = corpus.structures.filter(F.col("level") == level).select("docno", F.explode(F.array(F.struct(F.col("hstart").alias("s"), F.col("hend").alias("e")), F.struct(F.col("cstart").alias("s"), F.col("cend").alias("e")))).alias("f")).select("docno", "f.s", "f.e").distinct()
    f = F.struct("e", "s")
    ends = fields.select("docno", F.col("e").alias("at"), f.alias("f"))
    rows = ends.unionByName(points.select("docno", F.col("pos").alias("at")).distinct(), allowMissingColumns=True)
    # In descending order the frame only grows: one pass over a document, no pair of a point and a field.
    after = Window.partitionBy("docno").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    found = rows.select("docno", F.col("at").alias("pos"), F.col("f").isNull().alias("asked"), F.min("f").over(after).alias("f")).filter("asked AND f IS NOT NULL")
    return found.select("docno", "pos", F.col("f.s").alias("fstart"), F.col("f.e").alias("fend"))


def acl_users(corpus: Corpus, docno: int) -> DataFrame:
    return corpus.acl.filter(F.col("docno") == docno).select("username")


def acl_documents(corpus: Corpus, users: list[str]) -> DataFrame:
    return corpus.acl.filter(F.col("username").isin(users)).select("docno").distinct()


def values(corpus: Corpus, what: str, start: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct names in order: term types, structure types, terms of a type ("term:type"), document ids, users."""
    kind, _, arg = what.partition(":")
    source: DataFrame = {
        "types": lambda: corpus.postings.select(F.col("type").alias("value")),
        "structures": lambda: corpus.structures.select(F.col("struct").alias("value")),
        "term": lambda: corpus.postings.filter(F.col("type") == arg.lower()).select("value"),
        "docids": lambda: corpus.docs.select(F.col("docid").alias("value")),
        "users": lambda: corpus.acl.select(F.col("username").alias("value")),
    }[kind]()
    if start is not None:
        source = source.filter(F.col("value") >= start)
    if prefix is not None:
        source = source.filter(F.col("value").startswith(prefix))
    out = source.distinct().orderBy("value")
    return out.limit(limit) if limit else out


def document_statistics(corpus: Corpus, kind: str) -> DataFrame:
    """docno, number of distinct terms and number of occurrences of a type."""
    return corpus.postings.filter(F.col("type") == kind.lower()).groupBy("docno").agg(F.countDistinct("value").alias("terms"), F.count("*").alias("occurrences"))


def counters(corpus: Corpus) -> DataFrame:
    return corpus.docs.agg(F.count("*").alias("n"), F.max("docno").alias("max_docno"))


def structure_map(corpus: Corpus) -> DataFrame:
    """docno, struct, struct_index, header and the list of contents."""
    c = F.sort_array(F.collect_list(F.struct(F.col("cstart").alias("start"), F.col("cend").alias("end"))))
    return corpus.structures.groupBy("docno", "struct", "struct_index", "hstart", "hend").agg(c.alias("contents"))


def field_trees(fields: DataFrame) -> DataFrame:
    """For each (docno, start, end) the smallest other field that covers it, and whether it overlaps one without cover.

    Fields of a document are joined by document only, which its length bounds; a cover starts at or before the field."""
    f = fields.select("docno", "start", "end").distinct()
    o = f.select("docno", F.col("start").alias("ps"), F.col("end").alias("pe"))
    both = f.join(o, "docno").filter((F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")) & ((F.col("ps") != F.col("start")) | (F.col("pe") != F.col("end"))))
    cover = (F.col("ps") <= F.col("start")) & (F.col("pe") >= F.col("end"))
    inside = (F.col("ps") >= F.col("start")) & (F.col("pe") <= F.col("end"))
    best = both.groupBy("docno", "start", "end").agg(F.min(F.when(cover, F.struct((F.col("pe") - F.col("ps")).alias("n"), "ps", "pe"))).alias("p"), F.max((~cover & ~inside).cast("int")).alias("crossing"), F.sum(cover.cast("int")).alias("depth"))
    return f.join(best, ["docno", "start", "end"], "left").select("docno", "start", "end", F.col("p.ps").alias("parent_start"), F.col("p.pe").alias("parent_end"), F.coalesce("crossing", F.lit(0)).alias("crossing"), F.coalesce("depth", F.lit(0)).alias("depth"))


def check(corpus: Corpus) -> DataFrame:
    """Integrity: number of rows of each table that refer to no document or repeat a key.

    Positions of a document and type are bits of words of 64: where as many bits are set as there are rows, no key repeats.
    Rows of other words, of postings only, are grouped by their whole key."""
    corpus = corpus.dealt()
    known = corpus.docs.select("docno").distinct().withColumn("_known", F.lit(True)).hint("shuffle_hash")
    lost = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("orphans")
    again = F.coalesce(F.sum("again"), F.lit(0)).alias("repeats")

    def line(name: str, n: DataFrame) -> DataFrame:
        return n.join(known, "docno", "left").agg(lost, again).select(F.lit(name).alias("table"), "orphans", "repeats")

    def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("again", F.col("n") - 1)

    def words(df: DataFrame) -> DataFrame:
        bit = F.expr("shiftleft(1L, CAST(pos & 63 AS INT))")
        n = df.groupBy("docno", "type", F.shiftright("pos", 6).alias("_w")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("_b"), F.max(F.col("pos").isNull().cast("int")).alias("_null"))
        return n.select("docno", "type", "_w", "n", (F.col("n") - F.bit_count(F.coalesce("_b", F.lit(0))) - F.col("_null")).alias("again"))

    postings = words(corpus.postings).join(known, "docno", "left")
    orphans, suspect = postings.agg(lost, again).first()
    repeats = corpus.spark.range(1).select(F.lit(0).cast("bigint").alias("repeats"))
    if suspect:
        some = words(corpus.postings).filter("again > 0").select(*[F.col(k).alias(f"_{k}") for k in ("docno", "type")], F.col("_w").alias("_at"))
        there = F.col("docno").eqNullSafe(F.col("_docno")) & F.col("type").eqNullSafe(F.col("_type")) & F.shiftright("pos", 6).eqNullSafe(F.col("_at"))
        repeats = keyed(corpus.postings.join(some, there, "left_semi"), ["type", "value", "docno", "pos"]).agg(again)
    out = repeats.select(F.lit("postings").alias("table"), F.lit(orphans).cast("bigint").alias("orphans"), "repeats")
    for p in (line("forward", words(corpus.forward)), line("metadata", keyed(corpus.metadata, ["docno"])), line("attributes", keyed(corpus.attributes, ["docno", "name"]))):
        out = out.unionByName(p)
    return out


def sizes(corpus: Corpus) -> DataFrame:
    """Rows of each table, in place of sizes of key prefixes."""
    tables = {"docs": corpus.docs, "postings": corpus.postings, "forward": corpus.forward, "structures": corpus.structures, "metadata": corpus.metadata, "attributes": corpus.attributes}
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


