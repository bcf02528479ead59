"""Weighting functions: (docno, fstart, fend, weight) of candidate documents.  A whole document has the field (0, 0).

A function gets the corpus, the candidates (docno, distinct), its features by role, and parameters whose names are not
case-sensitive.  A feature is (expression, weight).  Parameters and roles that a function doesn't know are errors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import scalar

REGISTRY: dict[str, tuple[Callable, dict, tuple]] = {}


def define(called: str, roles: tuple = (), /, **defaults):
    def put(fn):
        REGISTRY[called.lower()] = (fn, defaults, roles)
        return fn

    return put


def call(name: str, corpus, candidates: DataFrame, features: dict[str, list], params: dict | None = None) -> DataFrame:
    try:
        fn, defaults, roles = REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown weighting function {name!r}") from None
    given = {k.lower(): v for k, v in (params or {}).items()}
    if unknown := set(given) - set(defaults) - {"__variables__"}:
        raise ValueError(f"{name} doesn't know the parameters {sorted(unknown)}")
    if unknown := {k.lower() for k in features} - set(roles):
        raise ValueError(f"{name} doesn't know the features {sorted(unknown)}")
    return fn(corpus, candidates, {k.lower(): v for k, v in features.items()}, {**defaults, **given})


def idf(n: int, df: int) -> float:
    return max(0.00001, math.log10((n - df + 0.5) / (df + 0.5))) if n - df + 0.5 > 0 else 0.00001


def dfs_of(corpus, features: list) -> list[int]:
    """Document frequencies of the features, all counted in one job."""
    corpus.dfs([(t.type.lower(), t.value) for e, _ in features for t in e.terms()])
    return [e.df(corpus) for e, _ in features]


def frequencies(corpus, features: list, candidates: DataFrame | None = None) -> DataFrame:
    """(docno, f, ff): how often each feature matches in a document.  Terms share one scan, expressions have one each."""
    from rankloom.plans.expr import Term

    parts = []
    terms = [(i, e) for i, (e, _) in enumerate(features) if isinstance(e, Term)]
    if terms:
        # A query's terms are few; as a literal map they find their features in the scan itself.
        keys: dict[str, list[int]] = {}
        for i, e in terms:
            keys.setdefault(f"{e.type.lower()}\x1f{e.value}", []).append(i)
        found = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
        hit = corpus.postings.filter(F.col("type").isin(sorted({e.type.lower() for _, e in terms})) & F.col("value").isin(sorted({e.value for _, e in terms})))
        rows = hit.select("docno", F.explode(found[F.concat_ws("\x1f", "type", "value")]).alias("f"))
        parts.append(rows.groupBy("docno", "f").agg(F.count("*").alias("ff")))
    for i, (e, _) in enumerate(features):
        if not isinstance(e, Term):
            parts.append(e.compile(corpus).groupBy("docno").agg(F.count("*").alias("ff")).select("docno", F.lit(i).alias("f"), "ff"))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.join(candidates.select("docno"), "docno", "left_semi") if candidates is not None else out


def _of_feature(values: list[float]):
    """A column that looks a feature's number up in a literal list."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("f") + 1)


def _summed(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    s = rows.groupBy("docno").agg(F.sum("w").alias("w"))
    return candidates.select("docno").join(s, "docno", "left").select("docno", F.lit(0).alias("fstart"), F.lit(0).alias("fend"), F.coalesce("w", F.lit(0.0)).alias("weight"))


def _need(features: dict, role: str) -> list:
    if not features.get(role):
        raise ValueError(f"a feature .{role} is needed")
    return features[role]


@define("bm25", ("match",), k1=1.5, b=0.75, avgdoclen=500.0, metadata_doclen="doclen")
def bm25(corpus, candidates, features, p):
    match = _need(features, "match")
    n, k1, b = corpus.n_docs(), float(p["k1"]), float(p["b"])
    weight = _of_feature([w * idf(n, d) * (k1 + 1) for (_, w), d in zip(match, dfs_of(corpus, match))])
    ff = frequencies(corpus, match, candidates)
    if b:
        ff = ff.join(corpus.metadata.select("docno", F.col(p["metadata_doclen"]).cast("double").alias("dl")), "docno")
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(float(p["avgdoclen"])))
    else:
        norm = F.lit(k1)
    return _summed(ff.select("docno", (weight * F.col("ff") / (F.col("ff") + norm)).alias("w")), candidates)


@define("frequency", ("match",), weight=1.0)
def frequency(corpus, candidates, features, p):
    match = _need(features, "match")
    return _summed(frequencies(corpus, match, candidates).select("docno", (_of_feature([w for _, w in match]) * F.col("ff")).alias("w")), candidates)


@define("constant", ("match",), weight=1.0, precalc=0)
def constant(corpus, candidates, features, p):
    match = _need(features, "match")
    out = _summed(frequencies(corpus, match, candidates).select("docno", (_of_feature([w * float(p["weight"]) for _, w in match])).alias("w")), candidates)
    return out.filter("weight <> 0") if int(p["precalc"]) else out


@define("metadata", (), name=None, weight=1.0)
def metadata(corpus, candidates, features, p):
    rows = corpus.metadata.select("docno", (F.col(p["name"]) * F.lit(float(p["weight"]))).cast("double").alias("w"))
    return candidates.select("docno").join(rows, "docno", "left").select("docno", F.lit(0).alias("fstart"), F.lit(0).alias("fend"), F.coalesce("w", F.lit(0.0)).alias("weight"))


def _metadata_names(p) -> list[str]:
    m = p["metadata"] or []
    return [x.strip() for x in m.split(",") if x.strip()] if isinstance(m, str) else list(m)


def _with_metadata(rows: DataFrame, corpus, names: list[str]) -> DataFrame:
    return rows.join(corpus.metadata.select("docno", *[F.col(x).alias(f"_m_{x}") for x in names]), "docno", "left") if names else rows


@define("scalar", (), function=None, metadata=())
def scalar_weight(corpus, candidates, features, p):
    names = _metadata_names(p)
    rows = _with_metadata(candidates.select("docno"), corpus, names)
    args = {"N": F.lit(float(corpus.n_docs()))} | {x: F.coalesce(F.col(f"_m_{x}"), F.lit(0)) for x in names}
    value = scalar.compile(p["function"], names=args, variables=p.get("__variables__"))
    return rows.select("docno", F.lit(0).alias("fstart"), F.lit(0).alias("fend"), value.alias("weight"))


@define("smart", ("match",), function=None, metadata=())
def smart(corpus, candidates, features, p):
    match, names, n = features.get("match", []), _metadata_names(p), corpus.n_docs()
    args = {"ff": F.col("ff"), "df": F.col("df"), "N": F.lit(float(n)), "qf": F.lit(float(len(match)))}
    meta = {x: F.coalesce(F.col(f"_m_{x}"), F.lit(0)) for x in names}
    value = scalar.compile(p["function"], names=args | meta, variables=p.get("__variables__"))
    if not match:
        rows = _with_metadata(candidates.select("docno", F.lit(0.0).alias("ff"), F.lit(0.0).alias("df")), corpus, names)
        return rows.select("docno", F.lit(0).alias("fstart"), F.lit(0).alias("fend"), value.alias("weight"))
    # Candidates times a query's features, a literal list: those that don't match count with ff 0.
    every = candidates.select("docno", F.explode(F.array(*[F.lit(i) for i, _ in enumerate(match)])).alias("f"))
    rows = every.join(frequencies(corpus, match, candidates), ["docno", "f"], "left").withColumn("ff", F.coalesce("ff", F.lit(0)).cast("double")).withColumn("df", _of_feature(dfs_of(corpus, match)))
    rows = _with_metadata(rows, corpus, names)
    return _summed(rows.select("docno", (_of_feature([w for _, w in match]) * value).alias("w")), candidates)


def describe(name: str) -> dict:
    fn, defaults, roles = REGISTRY[name.lower()]
    return {"name": name.lower(), "features": list(roles), "parameters": dict(defaults), "doc": fn.__doc__ or ""}
