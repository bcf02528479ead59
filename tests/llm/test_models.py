"""Toxicity, quality, licences, revisits, the queries' SQL and the pipeline."""

import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankloom.llm import cotrain, licences, toxicity, warc


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    y = np.asarray(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def synthetic(spark, n=1500, seed=5):
    """Texts of made-up words; toxic ones hold one of a few words or stems, poor ones are shouted."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(rng.integers(20, 80))]
        toxic, poor = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            words[rng.integers(len(words))] = rng.choice(["zounds", "blast" + "".join(rng.choice(list("xyz"), 3)), "drat"])
        text = " ".join(words)
        rows.append((i, text.upper() + "!!" if poor else text, "en", f"s{i % 5}", len(text)))
        if rng.random() < 0.6:
            labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = synthetic(spark)
    return docs.cache(), labels.cache(), {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}


def test_toxicity_on_the_held_out_fold(made):
    docs, labels, y = made
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    ids = [i for i in y if held_out(i)]
    assert auc(np.array([scores[i] for i in ids]), [y[i][1] for i in ids]) > 0.97
    flagged = [scores[i] >= 0.3 for i in ids]
    assert np.mean([f == bool(y[i][1]) for f, i in zip(flagged, ids)]) > 0.95


def test_no_label_of_the_held_out_fold_is_read(made):
    docs, labels, _ = made
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a.columns == b.columns).all() and np.allclose(a.weights, b.weights)
    text, meta = np.zeros((1, cotrain.TEXT_FEATURES)), np.zeros((1, cotrain.META_FEATURES))
    assert np.allclose(cotrain.train(docs, labels).score(text, meta), cotrain.train(docs, turned).score(text, meta))


def test_non_negative_risk_with_few_positives():
    none = toxicity.fit([np.array([1, 2], np.int32)], np.array([False]), 0.1)
    assert none.score(np.array([1], np.int32)) < 0.001
    texts = [np.array([7], np.int32)] * 10 + [np.array([i % 5], np.int32) for i in range(90)] + [np.array([7], np.int32)] * 10
    m = toxicity.fit(texts, np.array([True] * 10 + [False] * 100), 0.1)
    assert m.score(np.array([7], np.int32)) > 0.5 > 0.3 > m.score(np.array([1], np.int32))


def test_toxicity_edges(edges, nothing, spark):
    labels = spark.createDataFrame([(10, 1, 1), (1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(edges, labels)
    got = toxicity.score(edges, m).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.train(nothing, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(edges, m).columns == edges.columns
    q = cotrain.train(edges, labels)
    assert cotrain.score(edges, q).count() == edges.count() and cotrain.keep_good(nothing, q).count() == 0


def test_quality_on_the_held_out_fold(made):
    docs, labels, y = made
    scores = {r.doc_id: r.score for r in cotrain.score(docs, cotrain.train(docs, labels)).collect()}
    ids = [i for i in y if held_out(i)]
    assert auc(np.array([scores[i] for i in ids]), [y[i][0] for i in ids]) > 0.99
    assert np.mean([(scores[i] >= 0.5) == bool(y[i][0]) for i in ids]) > 0.97


def test_views_teach_each_other():
    """The second view starts with few labels and learns from the first."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    a = np.c_[y * 4.0 - 2 + rng.normal(size=2000), rng.normal(size=2000)]
    b = np.c_[(y * 2.0 - 1)[:, None] * 0.8 + rng.normal(size=(2000, 6)), rng.normal(size=(2000, 14))]
    known = np.where(np.arange(2000) < 40, y, -1)
    alone = cotrain.co_train(a, b, known, rounds=0).score(a[1000:], b[1000:])
    taught = cotrain.co_train(a, b, known, rounds=8).score(a[1000:], b[1000:])
    assert auc(taught[1], y[1000:]) > auc(alone[1], y[1000:])
    assert auc(taught[2], y[1000:]) > 0.97


def test_licences(spark, nothing):
    text = "intro\nReleased under the MIT License.\nfoo; LICENSED under the apache license, version 2.0! All rights reserved.\nLicensed under the Apache Licence, Version 2.0.\nlicensed shop\n"
    got = licences.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    exact = sorted((r.line, r.licence) for r in got if r.exact)
    assert exact == [(1, "mit"), (2, "all-rights-reserved"), (2, "apache-2.0")]
    near = [r for r in got if not r.exact and r.line == 3]
    assert near[0].licence == "apache-2.0" and near[0].differences == "license > licence"
    assert licences.scan(nothing).count() == 0
    with pytest.raises(ValueError):
        licences.Scanner({"x": "!!"})


def test_licences_are_confirmed_only_in_blocks_that_save():
    scanner = licences.Scanner(licences.TEMPLATES)
    asked = []
    saved = scanner.saved
    scanner.saved = lambda k, ws: asked.append((k, ws)) or (saved(k, ws) if k != "mit" else -1)
    line = "x " * 9000 + "RELEASED UNDER THE MIT LICENSE. All Rights Reserved. licensed shop"
    assert [(k, exact) for k, _, exact, _ in scanner.block(line)] == [("all-rights-reserved", True)]
    assert all(len(ws) <= len(scanner.words[k]) for k, ws in asked)
    scanner = licences.Scanner(licences.TEMPLATES)
    assert {k for k, _, exact, _ in scanner.block(line) if exact} == {"all-rights-reserved", "mit"}
    assert min(scanner.whole.values()) > 0 and scanner.block("licensed shop") == []


def test_licences_that_save_nothing_equal_sql(spark):
    """Capitals and long lines, in which the compressor finds nothing to save, hold the exact wording all the same."""
    filler = " ".join(f"w{i * 7919 % 10_007}" for i in range(4000))
    lines = ["ALL RIGHTS RESERVED.", "All Rights Reserved.", "RELEASED UNDER THE MIT LICENSE.", "Copyright 2019 Foo. ALL RIGHTS RESERVED."]
    lines += [x.upper() for x in licences.TEMPLATES.values()] + [f"{filler} {x} {filler}" for x in licences.TEMPLATES.values()]
    rows = [(i, f"intro\n{x}") for i, x in enumerate(lines)] + [(100, "\n".join(lines))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("exact").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(licences.ORACLE).fetchall()
    found = got.groupby(["doc_id", "licence"]).line.agg(["count", "min"]).reset_index()
    assert sorted(map(tuple, found.values.tolist())) == sorted(want) and len(want) == len(lines) + len(licences.TEMPLATES)
    assert (got.saved <= 0).any()


def test_revisits(spark):
    h = {"etag": "a", "date": "1", "server": "x"}
    rows = [
        (1, "http://www.A.com/p/?utm_x=1", 10, "response", 200, "d1", '"a"', None, h),
        (2, "https://a.com/p", 20, "revisit", 304, None, 'W/"a"', None, {"date": "2", "server": "y"}),
        (3, "https://a.com/p#f", 30, "revisit", 304, None, '"b"', None, None),
        (4, "https://a.com/p", 5, "revisit", 304, None, None, None, None),
        (5, "https://a.com/p", 40, "response", 404, "d2", None, None, None),
        (6, "https://a.com/p", 50, "revisit", 304, None, None, None, None),
        (7, None, 50, "revisit", 304, None, None, None, None),
        (8, "https://a.com/p", None, "revisit", 304, None, None, None, None),
        (6, "https://a.com/p", 50, "revisit", 304, None, None, None, None),
        (9, "https://a.com/p", 10, "revisit", 304, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, digest string, etag string, last_modified string, headers map<string,string>")
    for blocks in (1, 7, 1024):
        got = sorted(((r.record_id, r.state, r.refers_to, r.digest) for r in warc.resolve_revisits(df, blocks).collect()), key=str)
        assert got == sorted([(2, "resolved", 1, "d1"), (3, "mismatch", 1, None), (4, "missing", None, None), (6, "unchecked", 1, "d1"), (6, "unchecked", 1, "d1"), (7, "missing", None, None), (8, "missing", None, None), (9, "unchecked", 1, "d1")], key=str)
    assert {r.record_id: r.headers for r in warc.resolve_revisits(df).collect()}[2] == {"etag": "a", "date": "2", "server": "x"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_warc", "op6_licences"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    text = lambda d: sorted(str([None if v is None or pd.isna(v) else int(v) if not isinstance(v, str) else v for v in r]) for r in d[columns].astype(object).values.tolist())
    assert text(a) == text(b)


def test_pipeline(spark, sf, tmp_path):
    """Every stage in a row against a plain version of it over all that the stage before kept."""
    import corpus_pipeline as c
    import public_tokenizers as P
    from test_dedup import classes, plain_removed
    from test_tokens import JSON, check_packing
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    now, seen = docs, {}
    for name, stage in c.STAGES[:-1]:
        before = now
        now = c._common.cut(stage(spark, before, sf), name)
        assert now.columns == docs.columns
        seen[name] = [{r.doc_id: r for r in x.collect()} for x in (before, now)]
    before, after = seen["toxicity"]
    m = toxicity.train(docs, labels)
    weights = dict(zip(m.columns.tolist(), m.weights.tolist()))
    assert after == {i: r for i, r in before.items() if plain_score(r.text, weights, m.bias) < 0.3} and len(after) < len(before)
    before, after = seen["quality"]
    q = cotrain.train(spark.createDataFrame(list(before.values()), docs.schema), labels)
    good = lambda r: q.score(cotrain.text_features(r.text)[None], cotrain.meta_features(r.source, r.lang, r.n_chars)[None])[2][0] >= 0.5
    assert after == {i: r for i, r in before.items() if good(r)} and len(after) < len(before)
    before, after = seen["near_duplicates"]
    ids = sorted(before)
    words = [(before[i].text or "").encode().lower().split() for i in ids]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    k = classes(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert after == {ids[g]: before[ids[g]] for g in set(k)} and len(after) < len(before)
    before, after = seen["repeats"]
    data, gone = plain_removed([before[i].text for i in sorted(before)], 200)
    for i, b, g in zip(sorted(before), data, gone):
        text = bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore")
        assert (after[i].text or "") == text and (after[i].n_chars or 0) == len(text) and after[i].source == before[i].source
    last = c.STAGES[-1][1](spark, now, sf)
    assert last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = last.collect()
    assert {r.doc_id for r in got} == set(after)
    check_packing(now, got, Tokenizer.from_file(JSON))


def plain_score(text, weights, bias):
    """One text's score by loops over its words."""
    seen = set()
    for token in (text or "").lower().split():
        for w in re.findall(r"[^\W\d_]+", token):
            seen |= {w} | {f"{w[:k]}-{k}" for k in (4, 5) if len(w) >= k}
    z = bias + sum(weights.get(h, 0.0) for h in {zlib.crc32(x.encode()) % (1 << 22) for x in seen})
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_equal_loops(made):
    docs, labels, _ = made
    m = toxicity.train(docs, labels)
    weights = dict(zip(m.columns.tolist(), m.weights.tolist()))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert len(weights) > 3 and all(abs(got[r.doc_id] - plain_score(r.text, weights, m.bias)) < 1e-9 for r in docs.collect())


def test_features_chosen_by_spark_are_those_of_the_fit(made):
    """The fit over all features of the sampled texts, and the one over those that Spark chose, are one."""
    docs, labels, _ = made
    rows, prior = toxicity.sample(docs, labels, 4000, 20_000)
    every = sorted(rows.collect(), key=lambda r: (-r.y, r.doc_id))
    plain = toxicity.fit([np.array(r.h, np.int32) for r in every], np.array([r.y == 1 for r in every]), prior)
    made_ = toxicity.train(docs, labels)
    assert (plain.columns == made_.columns).all() and np.allclose(plain.weights, made_.weights)


def test_quality_fit_is_a_minimum():
    """Newton's result against the numeric gradient of the penalised loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(float)
    m = cotrain.Logistic().fit(x, y)
    z = np.c_[(x - m.mean) / m.scale, np.ones(300)]

    def loss(w):
        return sum(math.log1p(math.exp(-(2 * t - 1) * float(r @ w))) for r, t in zip(z, y)) + 0.5 * sum(k * v * v for k, v in zip([1, 1, 1, 1, 1e-3], w))

    for i in range(5):
        step = np.eye(5)[i] * 1e-4
        assert abs(loss(m.w + step) - loss(m.w - step)) / 2e-4 < 1e-2


def test_urls_without_a_host(spark):
    urls = ["dns:a.example", "urn:other:b", "https://www.A.com:443/x.html?b=1&utm_source=z#f", None, ""]
    got = [r.u for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", warc.canonical_url(F.col("url")).alias("u")).orderBy("i").collect()]
    assert got == ["dns:a.example", "urn:other:b", "a.com/x?b=1", None, ""]


def test_clashing_names(edges):
    """Columns that are called like the operators' own come through."""
    from rankloom.llm import near_copies, simhash, suffix_dedup

    names = ["_row", "doc", "_did", "_rk", "spans", "root", "node", "o", "at", "found"]
    df = edges
    for n in names:
        df = df.withColumn(n, F.lit(77))
    m = toxicity.fit([np.array([1], np.int32)], np.array([False]), 0.1)
    for got in (simhash.keep_first(df), near_copies.keep_first(df), suffix_dedup.strip(df), toxicity.keep_clean(df, m), cotrain.keep_good(df, cotrain.CoTrained(1.0))):
        assert got.columns == df.columns
        assert [tuple(r) for r in got.select(*names).distinct().collect()] == [(77,) * len(names)]
