"""Posting join operators: sets of (docno, pos, len) made from sets of (docno, pos, len).

Positional operators mark the rows of their arguments, put them in one set and use windows over a document's positions, so
that each needs one shuffle by document and no pair of positions is ever formed.  All expressions stay in the JVM, but for
`within` with arguments that may share a position, which runs a kernel per document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Builder = Callable[..., DataFrame]
_numbers = range
REGISTRY: dict[str, tuple[Builder, str]] = {}


def define(name: str, describe: str) -> Callable[[Builder], Builder]:
    """Registers an operator under a name that is not case-sensitive."""

    def put(fn: Builder) -> Builder:
        REGISTRY[name.lower()] = (fn, describe)
        return fn

    return put


def get(name: str) -> Builder:
    try:
        return REGISTRY[name.lower()][0]
    except KeyError:
        raise ValueError(f"unknown join operator {name!r}") from None


def _marked(args: list[DataFrame], cuts: list[DataFrame] = ()) -> DataFrame:
    """All rows of the arguments with their number, those of cuts with -1.  Terms of one collection share one scan."""
    numbered = [*enumerate(args), *((-1, c) for c in cuts)]
    scans: dict[int, list[tuple[int, tuple]]] = {}
    for i, a in numbered:
        if term := getattr(a, "_rankloom_term", None):
            scans.setdefault(id(term[0]), []).append((i, term))
    parts = []
    for same in scans.values():
        keys: dict[str, list] = {}
        for i, (_, kind, value, length) in same:
            keys.setdefault(f"{kind}\x1f{value}", []).append(F.struct(F.lit(length).alias("len"), F.lit(i).alias("arg")))
        found = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.array(*v))])
        hit = same[0][1][0].filter(F.col("type").isin(sorted({t[1] for _, t in same})) & F.col("value").isin(sorted({t[2] for _, t in same})))
        parts.append(hit.select("docno", "pos", F.explode(found[F.concat_ws("\x1f", "type", "value")]).alias("a")).select("docno", "pos", "a.len", "a.arg"))
    parts += [a.select("docno", "pos", "len", F.lit(i).alias("arg")) for i, a in numbered if not hasattr(a, "_rankloom_term")]
    return functools.reduce(DataFrame.unionByName, parts)


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@define("union", "positions of any argument; the longest length of equal positions")
def union(args, range=0, cardinality=0, **_):
    _need(1 <= len(args) <= 256 and not range and not cardinality, "union takes 1 to 256 arguments, no range and no cardinality")
    return _marked(args).groupBy("docno", "pos").agg(F.max("len").alias("len"))


@define("intersect", "positions that all arguments, or at least `cardinality` of them, have in common")
def intersect(args, range=0, cardinality=0, **_):
    _need(args and not range and 0 <= cardinality <= len(args), "intersect takes arguments, no range and a cardinality up to their number")
    if cardinality in (0, len(args)):
        first, *rest = (a.groupBy("docno", "pos").agg(F.max("len").alias("len")) for a in args)
        for r in rest:
            first = first.join(r.select("docno", "pos"), ["docno", "pos"])
        return first.select("docno", "pos", "len")
    return _marked(args).groupBy("docno", "pos").agg(F.max("len").alias("len"), F.countDistinct("arg").alias("_k")).filter(F.col("_k") >= cardinality).drop("_k")


@define("diff", "positions of the first argument that the second doesn't have")
def diff(args, range=0, cardinality=0, **_):
    _need(len(args) == 2 and not range and not cardinality, "diff takes two arguments, no range and no cardinality")
    return args[0].join(args[1].select("docno", "pos"), ["docno", "pos"], "left_anti").select("docno", "pos", "len")


@define("contains", "position 1 of the documents that hold all, or at least `cardinality`, of the arguments")
def contains(args, range=0, cardinality=0, **_):
    _need(args and not range and 0 <= cardinality <= len(args), "contains takes arguments, no range and a cardinality up to their number")
    k = cardinality or len(args)
    docs = _marked(args).select("docno", "arg").distinct()
    return docs.groupBy("docno").agg(F.count("*").alias("_k")).filter(F.col("_k") >= k).select("docno", F.lit(1).alias("pos"), F.lit(1).alias("len"))


@define("pred", "the positions before those of the argument")
def pred(args, range=0, cardinality=0, **_):
    _need(len(args) == 1 and not range and not cardinality, "pred takes one argument")
    return args[0].filter(F.col("pos") > 1).select("docno", (F.col("pos") - 1).alias("pos"), "len")


@define("succ", "the positions after those of the argument")
def succ(args, range=0, cardinality=0, **_):
    _need(len(args) == 1 and not range and not cardinality, "succ takes one argument")
    return args[0].select("docno", (F.col("pos") + 1).alias("pos"), "len")


def _up_to_here():
    return Window.partitionBy("docno").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)


def _from(ahead: int):
    """Rows at the position plus `ahead` and after it.  In descending order this frame only grows, so that Spark carries its
    aggregates on from row to row."""
    return Window.partitionBy("docno").orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, -ahead)


@define("between", "positions of the first argument from a start up to the next end, not included")
def between(args, range=0, cardinality=0, **_):
    _need(2 <= len(args) <= 3 and not range and not cardinality, "between takes an element, a start and perhaps an end")
    rows = _marked(args)
    end = 2 if len(args) == 3 else 1
    last_start = F.max(F.when(F.col("arg") == 1, F.col("pos"))).over(_up_to_here())
    # An element is inside if an end follows its last start, and comes after the element.
    end_after = F.min(F.when(F.col("arg") == end, F.col("pos"))).over(_from(1))
    closed = F.max(F.when(F.col("arg") == end, F.col("pos"))).over(_up_to_here())
    out = rows.select("*", last_start.alias("s"), end_after.alias("e"), closed.alias("c")).filter(F.col("arg") == 0)
    open_ = F.col("s").isNotNull() & F.col("e").isNotNull()
    if end == 2:
        open_ &= F.col("c").isNull() | (F.col("c") <= F.col("s"))
    return out.filter(open_).select("docno", "pos", "len").distinct()


def _window_end(found: DataFrame, range: int, end: Column, last: Column) -> DataFrame:
    """Windows within the range as result rows: at their start, or for a negative range at their end."""
    ok = found.filter(end - F.col("pos") <= abs(range))
    if range >= 0:
        return ok.select("docno", "pos", (last["at"] - F.col("pos") + last["n"]).cast("int").alias("len")).groupBy("docno", "pos").agg(F.max("len").alias("len"))
    return ok.select("docno", end.alias("pos"), F.lit(1).alias("len")).distinct()


def _in_range(args: list[DataFrame], range: int, cut: DataFrame | None, dfs: list[int] | None) -> DataFrame:
    rows = _marked(args, [] if cut is None else [cut])
    nearest = [F.min(F.when(F.col("arg") == i, F.struct(F.col("pos").alias("at"), F.col("len").alias("n")))).over(_from(0)).alias(f"n{i}") for i, _ in enumerate(args)]
    next_cut = F.min(F.when(F.col("arg") == -1, F.col("pos"))).over(_from(0)).alias("cut")
    found = rows.select("docno", "pos", "arg", *nearest, next_cut).filter(F.col("arg") >= 0)
    for i, _ in enumerate(args):
        found = found.filter(F.col(f"n{i}").isNotNull())
    end = F.greatest(*[F.col(f"n{i}")["at"] for i, _ in enumerate(args)], F.lit(0)) if len(args) > 1 else F.col("n0")["at"]
    if cut is not None:
        found = found.filter(F.col("cut").isNull() | (F.col("cut") > end))
    # A result's length is measured to the argument that is rarest.
    rare = min(enumerate(dfs), key=lambda x: (x[1], -x[0]))[0] if dfs else len(args) - 1
    return _window_end(found, range, end, F.col(f"n{rare}"))


@define("inrange", "windows of at most `range` positions that hold every argument; equal positions count for several")
def inrange(args, range=0, cardinality=0, dfs=None, **_):
    _need(args and not cardinality, "inrange takes arguments and no cardinality")
    return _in_range(args, range, None, dfs)


@define("inrange_struct", "as inrange, without a position of the first argument inside")
def inrange_struct(args, range=0, cardinality=0, dfs=None, **_):
    _need(len(args) >= 2 and not cardinality, "inrange_struct takes a delimiter and arguments")
    return _in_range(args[1:], range, args[0], dfs[1:] if dfs else None)


def distinct_windows(positions: list[list[int]], range: int, cuts: list[int]) -> list[tuple[int, int]]:
    """(start, end) for each start that has distinct positions, one of each argument, from it on with the least end.

    Earliest ends first: positions are taken in order, each by an argument that still lacks one (augmenting paths), until
    all have one.  A position that starts a window is always used, as an earlier start would have found the window else."""
    import bisect

    owners: dict[int, list[int]] = {}
    for i, ps in enumerate(positions):
        for p in ps:
            owners.setdefault(p, []).append(i)
    every, out = sorted(owners), []
    for k, m in enumerate(every):
        taken: dict[int, int] = {}

        def assign(p: int, seen: set[int]) -> bool:
            for i in owners[p]:
                if i not in seen:
                    seen.add(i)
                    if i not in taken or assign(taken[i], seen):
                        taken[i] = p
                        return True
            return False

        for p in every[k:]:
            if p - m > range:
                break
            assign(p, set())
            if len(taken) == len(positions):
                c = bisect.bisect_left(cuts, m)
                if m in taken.values() and not (c < len(cuts) and cuts[c] <= p):
                    out.append((m, p))
                break
    return out


def _within(args: list[DataFrame], range: int, cut: DataFrame | None, dfs: list[int] | None, disjoint: bool) -> DataFrame:
    if disjoint:
        return _in_range(args, range, cut, dfs)
    n = len(args)

    def run(frames):
        for pdf in frames:
            docnos, at, lengths = [], [], []
            for docno, codes in zip(pdf["docno"], pdf["codes"]):
                by: dict[int, list[int]] = {}
                for pos, arg in sorted({(int(c) >> 20, (int(c) & 0xFFFFF) - 1) for c in codes}):
                    by.setdefault(arg, []).append(pos)
                found = distinct_windows([by[i] for i in _numbers(n)], abs(range), by.get(-1, []))
                rows = sorted({(a, b - a + 1) for a, b in found}) if range >= 0 else sorted({(b, 1) for _, b in found})
                docnos += [docno] * len(rows)
                at += [r[0] for r in rows]
                lengths += [r[1] for r in rows]
            yield pd.DataFrame({"docno": docnos, "pos": at, "len": lengths}).astype({"docno": "int64", "pos": "int32", "len": "int32"})

    # One row per document, its matches as numbers; only documents that hold every argument reach the kernel.
    code = F.shiftleft(F.col("pos").cast("long"), 20) + F.col("arg") + 1
    rows = _marked(args, [] if cut is None else [cut]).groupBy("docno").agg(F.collect_list(code).alias("codes"), F.size(F.collect_set(F.when(F.col("arg") >= 0, F.col("arg")))).alias("k"))
    return rows.filter(F.col("k") == n).select("docno", "codes").mapInPandas(run, "docno long, pos int, len int")


@define("within", "as inrange, each argument at a position of its own")
def within(args, range=0, cardinality=0, dfs=None, disjoint=False, **_):
    _need(args and not cardinality, "within takes arguments and no cardinality")
    return _within(args, range, None, dfs, disjoint)


@define("within_struct", "as within, without a position of the first argument inside")
def within_struct(args, range=0, cardinality=0, dfs=None, disjoint=False, **_):
    _need(len(args) >= 2 and not cardinality, "within_struct takes a delimiter and arguments")
    return _within(args[1:], range, args[0], dfs[1:] if dfs else None, disjoint)


def _in_order(args: list[DataFrame], range: int, cut: DataFrame | None, ahead: int) -> DataFrame:
    rows = _marked(args, [] if cut is None else [cut])
    last = len(args) - 1
    rows = rows.withColumn("end", F.when(F.col("arg") == last, F.struct(F.col("pos").alias("at"), F.col("len").alias("n"))))
    for i in reversed(_numbers(last)):
        # The end of a match from argument i + 1 on, which starts as near as it can.
        follow = F.min(F.when(F.col("arg") == i + 1, F.struct(F.col("pos").alias("at"), F.col("end").alias("v")))).over(_from(ahead))["v"]
        rows = rows.withColumn("end", F.when(F.col("arg") == i, follow).otherwise(F.col("end")))
    next_cut = F.min(F.when(F.col("arg") == -1, F.col("pos"))).over(_from(0))
    found = rows.withColumn("cut", next_cut).filter((F.col("arg") == 0) & F.col("end").isNotNull())
    if cut is not None:
        found = found.filter(F.col("cut").isNull() | (F.col("cut") > F.col("end")["at"]))
    return _window_end(found, range, F.col("end")["at"], F.col("end"))


@define("sequence", "arguments in order, each after the one before, as near as can be, within `range` positions")
def sequence(args, range=0, cardinality=0, **_):
    _need(args and not cardinality, "sequence takes arguments and no cardinality")
    return _in_order(args, range, None, 1)


@define("sequence_struct", "as sequence, without a position of the first argument inside")
def sequence_struct(args, range=0, cardinality=0, **_):
    _need(len(args) >= 2 and not cardinality, "sequence_struct takes a delimiter and arguments")
    return _in_order(args[1:], range, args[0], 1)


@define("chain", "as sequence, equal positions allowed")
def chain(args, range=0, cardinality=0, **_):
    _need(args and not cardinality, "chain takes arguments and no cardinality")
    return _in_order(args, range, None, 0)


@define("chain_struct", "as chain, without a position of the first argument inside")
def chain_struct(args, range=0, cardinality=0, **_):
    _need(len(args) >= 2 and not cardinality, "chain_struct takes a delimiter and arguments")
    return _in_order(args[1:], range, args[0], 0)


@define("sequence_imm", "each argument starts where the one before ends")
def sequence_imm(args, range=0, cardinality=0, **_):
    _need(args and not range and not cardinality, "sequence_imm takes arguments, no range and no cardinality")
    now = args[0].select("docno", "pos", (F.col("pos") + F.col("len")).alias("end"))
    for a in args[1:]:
        follow = a.select("docno", F.col("pos").alias("end"), F.col("len").alias("n"))
        now = now.join(follow, ["docno", "end"]).select("docno", "pos", (F.col("end") + F.col("n")).alias("end"))
    return now.groupBy("docno", "pos").agg((F.max("end") - F.col("pos")).cast("int").alias("len"))


def df_estimate(name: str, dfs: list[int]) -> int:
    """The document frequency that the result is taken to have."""
    name = name.lower()
    if name == "union":
        return max(dfs)
    if name in ("diff", "pred", "succ", "between"):
        return dfs[0]
    return min(dfs[1:] if name.endswith("_struct") else dfs)
