"""A harbour's boats as a collection of our own: schemes, programs and weighting, against filters in Python."""

import dataclasses
import math

import pytest

from rankloom.plans import program
from rankloom.plans.expr import Join, Term
from rankloom.plans.query import Call, QueryEval
from rankloom.sources.corpus import Corpus

#: number: hull, cargo (each piece stands once), crew
BOATS = {
    1: ("steel", ["rope", "salt"], 4),
    2: ("wood", ["salt"], 9),
    3: ("steel", ["fish", "fish", "ice"], 2),
    4: ("wood", ["rope", "rope", "rope", "fish"], 7),
    5: ("steel", ["ice"], 5),
    6: ("reed", ["fish", "salt", "ice"], 1),
    7: ("wood", [], 3),
}


@pytest.fixture(scope="module")
def harbour(spark):
    posts = []
    for d, (hull, cargo, _) in BOATS.items():
        posts += [("word", "boat", d, 1, 1), ("hull", hull, d, 2, 1)] + [("cargo", c, d, 5 + k, 1) for k, c in enumerate(cargo)]
    meta = spark.createDataFrame([(d, crew, 10 * d) for d, (_, _, crew) in BOATS.items()], "docno long, crew int, doclen int")
    docs = spark.createDataFrame([(d, f"boat/{d}") for d in BOATS], "docno long, docid string")
    attributes = docs.selectExpr("docno", "'docid' AS name", "docid AS value")
    forward = spark.createDataFrame([(d, "orig", p, v) for t, v, d, p, _ in posts if t == "word"], "docno long, type string, pos int, value string")
    structures = spark.createDataFrame([], "docno long, struct string, struct_index int, hstart int, hend int, cstart int, cend int, level int")
    acl = spark.createDataFrame([("mira", 2), ("mira", 6), ("jo", 5)], "username string, docno long")
    return Corpus(docs, spark.createDataFrame(posts, "type string, value string, docno long, pos int, len int").cache(), forward, structures, meta, attributes, acl)


BOAT, ROPE, FISH, SALT = Term("word", "boat"), Term("cargo", "rope"), Term("cargo", "fish"), Term("cargo", "salt")
SCHEME = QueryEval(["wanted"], ["only"], ["never"], [Call("frequency", {"match": "count"})], [Call("attribute", {}, {"name": "docid"})])


def ask(c, wanted=BOAT, **sets):
    q = SCHEME.query(c).feature("count", BOAT).feature("wanted", wanted)
    for name, exprs in sets.items():
        for e in exprs:
            q.feature(name, e)
    return q


def numbers(q):
    return {int(r.value.split("/")[1]) for r in q.evaluate().summary.collect()}


def boats(keep):
    return {d for d, b in BOATS.items() if keep(*b)}


def test_sets(harbour):
    assert numbers(ask(harbour)) == set(BOATS)
    assert numbers(ask(harbour, never=[FISH, ROPE])) == boats(lambda hull, cargo, crew: not {"fish", "rope"} & set(cargo))
    assert numbers(ask(harbour, only=[Join("union", (SALT, FISH)), Term("hull", "steel")])) == boats(lambda hull, cargo, crew: {"salt", "fish"} & set(cargo) and hull == "steel")
    q = ask(harbour, only=[Join("union", (SALT, FISH))]).restrict("<=", "crew", 7)
    for k, v in enumerate((1, 4, 9)):
        q.restrict("=", "crew", v, k == 0)
    assert numbers(q) == boats(lambda hull, cargo, crew: {"salt", "fish"} & set(cargo) and crew <= 7 and crew in (1, 4, 9))
    assert numbers(ask(harbour, ROPE, only=[FISH])) == boats(lambda hull, cargo, crew: {"rope", "fish"} <= set(cargo))


def test_users_docset_paging_and_counts(harbour):
    q = ask(harbour)
    q.users = ["mira", "stranger"]
    assert numbers(q) == {2, 6}
    q = ask(harbour)
    q.docset = [7, 3, 55]
    assert numbers(q) == {3, 7}
    q = ask(harbour)
    q.min_rank, q.max_ranks = 2, 3
    assert [r.docno for r in q.evaluate().ranks.orderBy("rank").collect()] == [5, 4, 3], "equal weights: larger numbers first"
    q.max_ranks = 0
    assert q.evaluate().ranks.count() == 0
    r = ask(harbour, only=[FISH]).evaluate().stats.first()
    assert (r.ranked, r.visited) == (len(boats(lambda hull, cargo, crew: "fish" in cargo)), len(BOATS))


BM25 = QueryEval(["wanted"], weightings=[Call("BM25", {"match": "count"}, {"avgdoclen": 30})])


def bm25(df, n=len(BOATS), weight=1.5):
    idf = math.log10((n - df + 0.5) / (df + 0.5))
    count = {d: cargo.count("rope") for d, (_, cargo, _) in BOATS.items() if "rope" in cargo}
    return {d: weight * max(idf, 0.00001) * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * 10 * d / 30)) for d, k in count.items()}


def test_bm25_against_formula(harbour):
    ask_ = lambda: BM25.query(harbour).feature("count", ROPE, 1.5).feature("wanted", ROPE)
    weights = lambda q: {r.docno: r.weight for r in q.evaluate().ranks.collect()}
    assert weights(ask_()) == pytest.approx(bm25(2))
    assert weights(ask_().term_statistics("cargo", "rope", 1).global_statistics(90)) == pytest.approx(bm25(1, 90))
    assert weights(ask_()) == pytest.approx(bm25(2)), "a client's statistics hold for its query alone"


def test_unknown_parameters_are_errors(harbour):
    for bad in (Call("frequency", {"match": "count"}, {"speed": 1}), Call("frequency", {"speed": "count"}), Call("speed", {"match": "count"})):
        with pytest.raises(ValueError):
            QueryEval(["wanted"], weightings=[bad]).query(harbour).feature("count", BOAT).feature("wanted", BOAT).evaluate()
    with pytest.raises(ValueError):
        QueryEval(["wanted"]).query(harbour).feature("wanted", BOAT).evaluate()


def test_program(harbour):
    s = program.parse('TERM count boat : word; SELECT count; WEIGHT count; RESTRICT only; # who sails\nEVAL frequency(); EVAL metadata(name=crew, weight=0.25); FORMULA "_1 - _0"; SUMMARIZE id = attribute(name=docid);')
    assert s.view()["restrict"] == ["only"]
    q = s.query(harbour).feature("only", SALT)
    got = [(r.docno, r.weight) for r in q.evaluate().ranks.orderBy("rank").collect()]
    assert got == [(2, 1.25), (1, 0.0), (6, -0.75)]
    for bad in ("SELECT a; SELECT b;", "EVAL f(; ", "WEIGHT a; WEIGHT b;", "SAIL x;"):
        with pytest.raises(ValueError):
            program.parse(bad)


def test_empty_collection(harbour):
    empty = dataclasses.replace(harbour, postings=harbour.postings.limit(0), docs=harbour.docs.limit(0), _df={})
    assert ask(empty).evaluate().ranks.count() == 0
