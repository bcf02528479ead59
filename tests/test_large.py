"""Faults that showed on larger tables and odd texts: small copies of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_entry import same

#: Delimiters before the first word, no words, none at all, words of one kind, capitals, repeats, and letters beyond ASCII.
TEXTS = [
    "The cat of the dog and the bird. One of the two! Version of the and",
    "... of the. An end",
    "No end",
    "!!! ? . all the words come late. of the and",
    "Ünder the Österreich, the 12 of 3? of the",
    "",
    ". . . . .",
    "the the of the of licensed Licensed LICENSED idiot version",
    "12 34. 56! the",
    "the of and " * 40 + ". version idiot the of.",
]


def write(path, texts, spark):
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 20}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(0, len(rows), 3)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), TEXTS * 5, spark)


def oracle(sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return con.sql(entry.oracle_sql()[name]).df()


def test_update_of_documents_that_keep_no_word(spark, odd):
    assert same(entry.queries()["w02_partial_update"](spark, odd).toPandas(), oracle(odd, "w02_partial_update"))


NAMES = "w13_differences s16_sizes z04_listmatch j16_sequence_imm g05_metadata s15_check s07_document_terms j08_inrange j09_within s08_structure_at d01_changes d02_statistics_map z08_structheader a04_global_summary s06_forward s17_structure_map s18_field_trees w01_replace".split()


@pytest.fixture()
def not_kept(spark, monkeypatch):
    from rankloom.sources import corpus

    spark.catalog.clearCache()
    monkeypatch.setattr(corpus, "KEPT_BYTES", -1)
    monkeypatch.setattr(corpus, "_BUILT", {})


def test_large_collections_are_not_kept(spark, odd, not_kept):
    from rankloom.sources import corpus

    c = corpus.from_tables(spark, odd)
    assert not any(getattr(c, t).storageLevel.useMemory for t in ("postings", "forward", "structures"))


@pytest.mark.parametrize("name", NAMES)
def test_tables_from_texts_equal_sql(spark, odd, not_kept, name):
    assert same(entry.queries()[name](spark, odd).toPandas(), oracle(odd, name))


def test_differences_of_rows(spark, odd, not_kept):
    from pyspark.sql import functions as F

    from rankloom.operators import storage
    from rankloom.sources import corpus

    c = corpus.from_tables(spark, odd)
    more = c.postings.filter("docno = 1 AND pos <= 2").unionByName(c.postings.filter("docno = 9 AND value = 'the' AND pos = 1"))
    b = corpus.dataclasses.replace(c, postings=c.postings.filter("docno <> 2 AND NOT (docno = 8 AND pos = 3)").unionByName(more).withColumn("len", F.expr("IF(docno = 5 AND pos = 1, 7, len)")))
    got = {(r["only_in"], r["rows"]) for r in storage.differences(c, b, ("postings",)).collect()}
    x, y = c.postings, b.postings
    assert got == {("first", x.exceptAll(y).count()), ("second", y.exceptAll(x).count())}


def test_check_counts_orphans_and_repeats(spark, odd, not_kept):
    """Repeats of whole keys only, at positions that other rows share, beyond a word of bits, and without a position."""
    from pyspark.sql import functions as F

    from rankloom.operators import readers
    from rankloom.sources import corpus

    c = corpus.from_tables(spark, odd)
    p = c.postings
    rows = [("word", "new", 1, 1), ("word", "new", 1, 1), ("word", "new", 1, None), ("word", "new", 1, None), ("word", "other", 1, None), ("word", "lost", 999, 3)]
    more = spark.createDataFrame(rows, "type string, value string, docno long, pos int").withColumn("len", F.lit(1))
    b = corpus.dataclasses.replace(c, postings=p.unionByName(p.filter("docno = 10 AND pos IN (70, 120)")).unionByName(more), forward=c.forward.unionByName(c.forward.filter("docno = 10 AND pos = 99")).unionByName(spark.createDataFrame([(888, "orig", None, "x")] * 2, "docno long, type string, pos int, value string").select(*c.forward.columns)))
    got = {r["table"]: (r["orphans"], r["repeats"]) for r in readers.check(b).collect()}

    def plain(t, keys):
        known = {r["docno"] for r in b.docs.collect()}
        rows = [tuple(r[k] for k in keys) for r in t.select(*keys).collect()]
        return sum(r[keys.index("docno")] not in known for r in rows), len(rows) - len(set(rows))

    assert got == {"postings": plain(b.postings, ["type", "value", "docno", "pos"]), "forward": plain(b.forward, ["docno", "type", "pos"]), "metadata": (0, 0), "attributes": (0, 0)}
    assert got["postings"] == (1, 4) and got["forward"] == (2, 3)


@pytest.mark.parametrize("params", [{}, {"metadata_doclen": "n_chars", "struct": "title", "hotspots": 2}, {"maxdf": 0.3, "cluster": 0.9}])
def test_bm25pff_from_texts_equals_that_of_tables(spark, tmp_path, not_kept, params):
    """Found in a text as in the tables, for candidates without a hit, texts that are null, terms given twice and delimiters."""
    from rankloom.operators import weighting
    from rankloom.plans.expr import Term
    from rankloom.sources import corpus

    c = corpus.from_tables(spark, write(tmp_path, [*TEXTS, None], spark))
    tables = corpus.dataclasses.replace(c, _texts=None)
    the, of = Term("word", "the", 2), Term("word", "of")
    features = {"match": [(the, 1.0), (of, 0.5), (the, 1.0), (Term("eos", ""), 0.1), (Term("word", "."), 1.0)], "punct": [(Term("eos", ""), 1.0)]}
    candidates = c.docs.select("docno").filter("docno <> 3")
    got, expected = ([tuple(r) for r in weighting.call("bm25pff", x, candidates, features, {"avgdoclen": 20, **params}).collect()] for x in (c, tables))
    assert sorted(got) == sorted(expected) and len({r[0] for r in got}) == len(TEXTS)


def test_bm25pff_of_a_large_collection_moves_texts_alone(spark, odd, not_kept):
    """Tokens are no rows but in the selection; structures, lengths and hits aren't dealt one by one."""
    df = entry.queries()["g02_bm25pff"](spark, odd)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "collect_list" not in plan and "FlatMap" not in plan


def test_fields_cost_what_they_hold():
    """Sums of fields, nested and empty, against those over all nodes; nodes of a field are found, not sought."""
    import random

    from rankloom.operators import proximity as p

    rnd = random.Random(5)
    seen = []

    class Node(p.Node):
        def __getattribute__(self, name):
            if name == "pos":
                seen.append(1)
            return super().__getattribute__(name)

    c = p.Config(hotspots=400)
    make = lambda: [Node(i % 3, 5 * i + 1, 1, imm=i % 2, near=1) for i in range(400)]
    fields = [p.Field("s", 10 * i + 1, 10 * i + 11, 10 * i + 1, 10 * i + 11) for i in range(200)]
    p.field_frequencies(make(), 3, 3, c, fields)
    assert len(seen) < 20_000
    nested = [p.Field("s", a, a + rnd.randrange(9), b := rnd.randrange(2000), b + rnd.randrange(300)) for a in rnd.sample(range(2000), 60)]
    nodes, got = make(), p.field_frequencies(make(), 3, 3, c, nested)
    for f in nested:
        head = {x.feature for x in nodes if f.hstart <= x.pos < f.hend}
        for x in nodes:
            if head and (f.hstart, f.hend) != (f.cstart, f.cend) and f.cstart <= x.pos < f.cend:
                x.title = max(x.title, len(head - {x.feature}))
    hot = sorted(nodes, key=lambda x: (-x.total(), x.pos))[: c.hotspots]
    expected = {(f.cstart, f.cend): [sum(p.ff_weight(x, 3, c) for x in nodes if x.feature == k and f.cstart <= x.pos < f.cend) for k in range(3)] for f in nested if any(f.cstart <= x.pos < f.cend for x in hot)}
    assert got.keys() - {(0, 0)} == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


@pytest.mark.parametrize("common", [1, 30, 10**6])
def test_document_terms_of_texts_are_counted_in_rows(spark, tmp_path, not_kept, monkeypatch, common):
    """Terms that all, some and no frequencies are sent for; no token is a row, and only the others' rows are dealt."""
    from rankloom.operators import readers

    monkeypatch.setattr(readers, "COMMON_TERMS", common)
    monkeypatch.setattr(readers, "BATCH_ROWS", 7)
    sf = write(tmp_path, [*TEXTS, None] * 3, spark)
    df = entry.queries()["s07_document_terms"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Repartition" not in plan and "Join" not in plan
    assert same(df.toPandas(), oracle(sf, "s07_document_terms"))
