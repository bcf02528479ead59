"""Changes, snapshots, loaders, restrictions, statistics and vectors."""

import struct

import pytest
from pyspark.sql import functions as F

from rankloom.operators import readers, storage, vectors
from rankloom.plans.restrict import Compare, column
from rankloom.sources import loaders
from rankloom.sources.corpus import build
from rankloom.streaming import stats


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(0, "The cat sat. A dog ran!", "en", "s1", 23), (1, "", "en", "s1", 0), (2, None, None, "s2", None), (3, "Solo", "de", "s2", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    return build(docs, labels).persist()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_build(small):
    assert rows(small.term("word", "cat")) == [(1, 2, 1)]
    assert rows(small.term("eos", "")) == [(1, 4, 1), (1, 8, 1)]
    assert rows(small.metadata) == [(1, 6, 23, 1, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 1, 4, 0, 1)]
    assert rows(small.structures.filter("struct = 'title'").select("docno", "hstart", "hend", "cstart", "cend")) == [(1, 1, 4, 4, 9)]
    assert rows(small.structures.filter("struct = 'sentence'").select("docno", "cstart", "cend")) == [(1, 1, 4), (1, 5, 8), (4, 1, 2)]
    assert all(r.orphans == r.repeats == 0 for r in readers.check(small).collect())


def test_delete_and_replace(spark, small):
    gone = storage.delete(small, spark.createDataFrame([("D0",), ("Dxx",)], "docid string"))
    assert gone.docs.count() == 3 and gone.term("word", "cat").count() == 0 and gone.metadata.count() == 3
    new = build(spark.createDataFrame([(0, "A cat", "en", "s1", 5), (9, "Cat two", "en", "s1", 7)], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    after = storage.replace(small, new)
    assert rows(after.docs.select("docid")) == [("D0",), ("D1",), ("D2",), ("D3",), ("D9",)]
    assert after.docs.select("docno").distinct().count() == 5
    assert sorted(p for _, p, _ in rows(after.term("word", "cat"))) == [1, 2]
    assert rows(after.term("word", "sat")) == []
    assert storage.differences(small, small).agg(F.sum("rows")).first()[0] == 0


def test_snapshots(spark, small, tmp_path):
    store = storage.Store(spark, f"file://{tmp_path}/c")
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.open()
    store.commit(small)
    assert rows(store.open().postings) == rows(small.postings)
    store.commit(storage.delete(small, spark.createDataFrame([("D0",)], "docid string")))
    assert store.open().term("word", "cat").count() == 0
    store.backup(f"file://{tmp_path}/b")
    assert storage.Store(spark, f"file://{tmp_path}/b").open().docs.count() == 3
    store.destroy()
    assert not store.exists()


@pytest.mark.parametrize("kind,value,want", [("int8", 300, 127), ("int8", -300, -128), ("uint8", -4, 0), ("uint8", 256, 255), ("uint16", 70000, 65535), ("int32", 5, 5), ("uint32", 2**40, 2**32 - 1)])
def test_clamped(spark, kind, value, want):
    assert spark.range(1).select(storage.stored(F.lit(value), kind)).first()[0] == want


def test_negative_df_is_an_error(spark, small):
    bad = spark.createDataFrame([("word", "cat", -5)], "type string, value string, increment long")
    with pytest.raises(Exception, match="negative"):
        storage.term_statistics(small, bad).collect()


def test_loaders(spark, small, tmp_path):
    (tmp_path / "v").write_text("D0 5\nDnone 6\n_2 7\nD0 8\n4 9\n")
    assert rows(loaders.assignments(spark, f"file://{tmp_path}/v", small)) == [(1, "8"), (2, "7"), (4, "9")]
    (tmp_path / "w").write_text("de x\n")
    assert rows(loaders.assignments(spark, f"file://{tmp_path}/w", small, "lang")) == [(4, "x")]
    assert rows(storage.set_metadata(small, loaders.assignments(spark, f"file://{tmp_path}/v", small), "quality").metadata.select("docno", "quality")) == [(1, 8), (2, 7), (3, 0), (4, 9)]
    cleared = storage.set_attribute(small, spark.createDataFrame([(1, ""), (2, "fr")], "docno long, value string"), "lang")
    assert rows(cleared.attributes.filter("name = 'lang'").select("docno", "value")) == [(2, "fr"), (4, "de")]
    (tmp_path / "r").write_text("D0 +ann,-s1\nD3 -,bob\nD1 ann\n")
    assert rows(loaders.user_rights(spark, f"file://{tmp_path}/r", small)) == [("ann", 1), ("ann", 2), ("bob", 4), ("s1", 2), ("s2", 3)]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "t").write_text("2 2\nnoun#cat 1 0.5\ndog 0 1\n")
    assert rows(loaders.vectors_text(spark, f"file://{tmp_path}/t", "#")) == [("", "dog", [0.0, 1.0]), ("noun", "cat", [1.0, 0.5])]
    for big in (False, True):
        (tmp_path / "b").write_bytes(b"2 2\n" + b"".join(n + b" " + struct.pack(">2f" if big else "<2f", *v) + b"\n" for n, v in ((b"cat", (1, 0.5)), (b"dog", (0, 1)))))
        assert rows(loaders.vectors_binary(spark, f"file://{tmp_path}/b", None, big)) == [("", "cat", [1.0, 0.5]), ("", "dog", [0.0, 1.0])]


def test_float_tolerance(spark):
    df = spark.createDataFrame([(1.0,), (1.0004,), (1.01,), (None,)], "x double")
    count = lambda op, kind: df.filter(column([Compare(op, "x", 1.0, True, kind)])).count()
    assert [count(o, "float16") for o in ("=", "<", "<=", ">", ">=", "!=")] == [2, 1, 3, 1, 3, 2]
    assert [count(o, "float32") for o in ("=", ">")] == [1, 2]


def test_stream_equals_batch(spark, small, tmp_path):
    changes = stats.changes(small).selectExpr("timestamp '2024-01-01' AS ts", "node", "type", "value", "increment")
    changes.repartition(3).write.parquet(f"file://{tmp_path}/ch")
    for turn in range(2):
        q = stats.stream(spark, f"file://{tmp_path}/ch", f"file://{tmp_path}/cp{turn}", f"df{turn}")
        q.awaitTermination(120)
        assert rows(spark.table(f"df{turn}")) == rows(stats.statistics(changes))
    assert (stats.DOCUMENTS, "", 4) in rows(stats.statistics(changes))


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vectors.similar(v, [1.0, 1.0], 2).collect()] == [1, 2]
    assert {r.vec_id for r in vectors.similar_by_projection(v, [1.0, 1.0], 3).collect()} <= {0, 1, 2, 3, 4, 9}
