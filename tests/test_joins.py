"""Posting joins against brute force over random documents."""

import itertools
import random

import pytest

from rankloom.operators import joins

DOCS, ARGS = 40, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    sets = [{d: sorted(rng.sample(range(1, 25), rng.randint(0, 7))) for d in range(1, DOCS)} for _ in range(ARGS + 1)]
    frames = [spark.createDataFrame([(d, p, 1) for d, ps in s.items() for p in ps], "docno long, pos int, len int").cache() for s in sets]
    return sets, frames


def nxt(ps, x):
    return next((p for p in ps if p >= x), None)


def brute(name, sets, d, r, cut, card):
    """Result positions of one document."""
    a = [s[d] for s in sets]
    c = cut[d] if cut else []
    free = lambda x, y: not any(x <= p <= y for p in c)
    if name == "union":
        return {p for ps in a for p in ps}
    if name == "intersect":
        k = card or len(a)
        return {p for p in range(1, 40) if sum(p in ps for ps in a) >= k}
    if name == "diff":
        return set(a[0]) - set(a[1])
    if name == "contains":
        return {1} if sum(bool(ps) for ps in a) >= (card or len(a)) else set()
    if name == "pred":
        return {p - 1 for p in a[0] if p > 1}
    if name == "succ":
        return {p + 1 for p in a[0]}
    if name == "between":
        ends = a[2] if len(a) > 2 else a[1]
        return {p for p in a[0] for s in a[1] if (e := nxt(ends, s + 1)) is not None and s <= p < e}
    if name == "sequence_imm":
        return {p for p in a[0] if all(p + i in ps for i, ps in enumerate(a))}
    out = set()
    if name.startswith(("inrange", "within")):
        for m in sorted({p for ps in a for p in ps}):
            best = None
            if name.startswith("inrange"):
                ends = [nxt(ps, m) for ps in a]
                best = max(ends) if None not in ends else None
            else:
                for combo in itertools.product(*[[p for p in ps if m <= p <= m + abs(r)] for ps in a]):
                    if len(set(combo)) == len(combo) and min(combo) == m and (best is None or max(combo) < best):
                        best = max(combo)
            if best is not None and best - m <= abs(r) and free(m, best):
                out.add(m if r >= 0 else best)
        return out
    ahead = 1 if name.startswith("sequence") else 0
    for p0 in a[0]:
        p = p0
        for ps in a[1:]:
            p = nxt(ps, p + ahead) if p is not None else None
        if p is not None and p - p0 <= abs(r) and free(p0, p):
            out.add(p0 if r >= 0 else p)
    return out


CASES = [("union", 3, 0, 0), ("intersect", 3, 0, 0), ("intersect", 3, 0, 2), ("diff", 2, 0, 0), ("contains", 3, 0, 0), ("contains", 3, 0, 2), ("pred", 1, 0, 0), ("succ", 1, 0, 0), ("between", 2, 0, 0), ("between", 3, 0, 0), ("sequence_imm", 2, 0, 0)]
CASES += [(n, k, r, 0) for n in ("inrange", "within", "sequence", "chain") for k, r in ((1, 3), (2, 5), (3, 8), (3, -8))]
CASES += [(n, k, r, 0) for n in ("inrange_struct", "within_struct", "sequence_struct", "chain_struct") for k, r in ((2, 8), (3, -12))]


@pytest.mark.parametrize("name,n,r,card", CASES)
def test_join(data, name, n, r, card):
    sets, frames = data
    cut = name.endswith("_struct")
    args = ([frames[ARGS]] if cut else []) + frames[:n]
    got = joins.get(name)(args, range=r, cardinality=card).select("docno", "pos").collect()
    want = {(d, p) for d in range(1, DOCS) for p in brute(name, sets[:n], d, r, sets[ARGS] if cut else None, card)}
    assert len(got) == len(set(got))
    assert {(x.docno, x.pos) for x in got} == want


def test_within_of_the_same_argument(data):
    sets, frames = data
    got = {(x.docno, x.pos) for x in joins.get("within")([frames[0], frames[0], frames[1]], range=9).collect()}
    assert got == {(d, p) for d in range(1, DOCS) for p in brute("within", [sets[0], sets[0], sets[1]], d, 9, None, 0)}


def test_a_long_document(spark):
    """One document with many matches: frames that grow are carried on, not made anew for each row."""
    import time

    a, b = (spark.range(60_000).selectExpr("1L AS docno", f"cast(id * 3 + {k} AS int) AS pos", "1 AS len") for k in (1, 2))
    began = time.time()
    assert joins.get("inrange")([a, b], range=2).count() == 60_000 + 59_999
    assert joins.get("sequence")([a, b], range=1).count() == 60_000
    assert time.time() - began < 60


def test_errors(data):
    _, frames = data
    for name, args, more in (("diff", frames[:1], {}), ("union", frames[:2], {"range": 3}), ("contains", frames[:2], {"cardinality": 3}), ("pred", frames[:2], {}), ("nosuch", frames[:1], {})):
        with pytest.raises(ValueError):
            joins.get(name)(args, **more)


def test_custom_operator(data):
    from rankloom import engine

    engine.define_join("first_only", lambda args, **_: args[0].filter("pos = 1"), "position one")
    assert "first_only" in engine.functions()["join"]
    assert {x.pos for x in joins.get("FIRST_ONLY")(data[1][:1]).collect()} <= {1}
