"""Summarizers: (docno, fstart, fend, name, value, weight, idx) of ranked documents or fields.

A summarizer gets the corpus, the ranks (docno, fstart, fend; (0, 0) is a whole document), features by role, parameters
and an id; results are named by the id, or the summarizer's name, and for some a name after a colon.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import proximity, weighting
from rankloom.operators.field_weighting import config, same_terms

REGISTRY: dict[str, tuple] = {}
#: Those whose results over all ranks make up the global summary.
GLOBAL = {"accumatch", "accunear"}


def define(called: str, roles: tuple = (), /, **defaults):
    def put(fn):
        REGISTRY[called.lower()] = (fn, defaults, roles)
        return fn

    return put


def call(name: str, corpus, ranks: DataFrame, features: dict | None = None, params: dict | None = None, id: str | None = None) -> DataFrame:
    try:
        fn, defaults, roles = REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown summarizer {name!r}") from None
    given = {k.lower(): v for k, v in (params or {}).items()}
    aliases = {"structno": "struct"} if name.lower() == "structheader" else {}
    given = {aliases.get(k, k): v for k, v in given.items()}
    if unknown := set(given) - set(defaults) - {"__variables__"}:
        raise ValueError(f"{name} doesn't know the parameters {sorted(unknown)}")
    if unknown := {k.lower() for k in features or {}} - set(roles):
        raise ValueError(f"{name} doesn't know the features {sorted(unknown)}")
    return fn(corpus, ranks.select("docno", "fstart", "fend"), {k.lower(): v for k, v in (features or {}).items()}, {**defaults, **given}, id or name.lower())


def _out(df: DataFrame, name, value, weight=None, idx=None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("docno", "fstart", "fend", as_column(name).alias("name"), as_column(value).cast("string").alias("value"), as_column(1.0 if weight is None else weight).cast("double").alias("weight"), as_column(-1 if idx is None else idx).cast("int").alias("idx"))


def _inside(pos: Column) -> Column:
    return ((F.col("fstart") == 0) & (F.col("fend") == 0)) | ((pos >= F.col("fstart")) & (pos < F.col("fend")))


@define("metadata", (), name=None)
def metadata(corpus, ranks, features, p, id):
    return _out(ranks.join(corpus.metadata.select("docno", F.col(p["name"]).alias("_v")), "docno", "left"), id, F.coalesce("_v", F.lit(0)))


@define("attribute", (), name=None)
def attribute(corpus, ranks, features, p, id):
    hit = corpus.attributes.filter(F.col("name") == p["name"].lower()).select("docno", F.col("value").alias("_v"))
    return _out(ranks.join(hit, "docno").filter(F.col("_v") != ""), id, F.col("_v"))


@define("content", (), type=None, results=100)
def content(corpus, ranks, features, p, id):
    hit = corpus.forward.filter(F.col("type") == p["type"].lower()).select("docno", "pos", F.col("value").alias("_v"))
    rows = ranks.join(hit, "docno").filter(_inside(F.col("pos")))
    k = F.row_number().over(Window.partitionBy("docno", "fstart", "fend").orderBy("pos"))
    return _out(rows.withColumn("_k", k).filter(F.col("_k") <= int(p["results"])), id, F.col("_v"), None, F.col("pos"))


def _matches(corpus, ranks, features, p) -> DataFrame:
    """docno, field, feature, pos, weight and the formatted string of every match."""
    match = features.get("match") or []
    if not match:
        raise ValueError("a feature .match is needed")
    fmt = p["fmt"] or ("{text}" if p["text"] else "{tag}" if p["tag"] else "{pos}")
    parts = []
    for i, (e, w) in enumerate(match):
        rows = ranks.join(e.compile(corpus).select("docno", "pos"), "docno").filter(_inside(F.col("pos")))
        parts.append(rows.select("docno", "fstart", "fend", F.lit(i).alias("f"), "pos", F.lit(float(w)).alias("w")))
    rows = functools.reduce(DataFrame.unionByName, parts)
    # A variable's own position: that of the nearest match of the expression that carries it.
    carried = {e.variable: e for m, _ in match for e in [m, *getattr(m, "args", ())] if e.variable}
    wanted = re.findall(r"\{(\w+)(?::(\w+))?\}", fmt)
    texts: dict[tuple[str, str], str] = {}

    def at_variable(rows: DataFrame, v: str) -> DataFrame:
        if f"_p_{v}" in rows.columns:
            return rows
        hit = carried[v].compile(corpus).select("docno", F.col("pos").alias("_q"))
        near = rows.select("docno", "pos").distinct().join(hit, "docno").filter(F.col("_q") >= F.col("pos")).groupBy("docno", "pos").agg(F.min("_q").alias(f"_p_{v}"))
        return rows.join(near, ["docno", "pos"], "left")

    def forward_of(rows: DataFrame, kind: str, pos: str, to: str) -> DataFrame:
        hit = corpus.forward.filter(F.col("type") == p[kind].lower()).select("docno", F.col("pos").alias(pos), F.col("value").alias(to))
        return rows.join(hit, ["docno", pos], "left")

    for what, v in wanted:
        kind, var = (what, v) if what in ("pos", "tag", "text") else ("text" if p["text"] else "pos", what)
        pos = "pos"
        if var:
            if var not in carried:
                continue
            rows = at_variable(rows, var)
            pos = f"_p_{var}"
        if kind != "pos" and (to := f"_{kind}_{var}") not in rows.columns:
            rows = forward_of(rows, kind, pos, to)
            if p["strip"]:
                chars = "[" + "".join(re.escape(c) for c in p["strip"]) + "]+"
                rows = rows.withColumn(to, F.regexp_replace(F.regexp_replace(to, chars, " "), " $", ""))
        texts[what, v] = f"_{kind}_{var}" if kind != "pos" else pos
    pieces, last = [], 0
    for m in re.finditer(r"\{(\w+)(?::(\w+))?\}", fmt):
        pieces.append(F.lit(fmt[last : m.start()]))
        key = (m.group(1), m.group(2) or "")
        pieces.append(F.coalesce(F.col(texts[key]).cast("string"), F.lit("")) if key in texts else F.lit(""))
        last = m.end()
    pieces.append(F.lit(fmt[last:]))
    return rows.withColumn("_v", F.concat(*pieces))


_MATCH = dict(text=None, tag=None, fmt=None, strip=None, results=30)


@define("listmatch", ("match",), **_MATCH)
def listmatch(corpus, ranks, features, p, id):
    rows = _matches(corpus, ranks, features, p)
    k = F.row_number().over(Window.partitionBy("docno", "fstart", "fend").orderBy("f", "pos"))
    return _out(rows.withColumn("_k", k).filter(F.col("_k") <= int(p["results"])), id, F.col("_v"), F.col("w"), F.col("pos"))


@define("accumatch", ("match",), **_MATCH)
def accumatch(corpus, ranks, features, p, id):
    rows = _matches(corpus, ranks, features, p).groupBy("docno", "fstart", "fend", "_v").agg(F.sum("w").alias("w"))
    k = F.row_number().over(Window.partitionBy("docno", "fstart", "fend").orderBy(F.col("w").desc(), "_v"))
    return _out(rows.withColumn("_k", k).filter(F.col("_k") <= int(p["results"])), id, F.col("_v"), F.col("w"))


def parse_collect(text: str) -> dict[str, str]:
    return dict(x.strip().split("=", 1) for x in text.split(";") if x.strip())


@define("accunear", ("match", "punct"), collect="name=near;type=orig", maxdf=0.5, results=20, dist_imm=2, dist_close=8, dist_near=40, dist_sentence=20, dist_collect=8, cluster=0.7, ffbase=0.1)
def accunear(corpus, ranks, features, p, id):
    """Forward values around matches, by the weights of the matches."""
    match = features.get("match") or []
    n_docs, n, c, dist = corpus.n_docs(), len(match), config(p), int(p["dist_collect"])
    dfs = weighting.dfs_of(corpus, match)
    rare = [i for i in range(n) if dfs[i] <= float(p["maxdf"]) * n_docs]
    ws = [match[i][1] * weighting.idf(n_docs, dfs[i]) for i in rare]
    norm = math.sqrt(sum(w * w for w in ws)) or 1.0
    rows = proximity.gathered(corpus, ranks.select("docno").distinct(), [match[i] for i in rare], features.get("punct", []))

    def near(row):
        found, eos = proximity.split(row.hits, len(rare))
        kept = proximity.clustered(proximity.touches(found, eos, c, same_terms([match[i] for i in rare])), len(rare), c) if len(rare) > 1 else [proximity.Node(0, a, b) for a, b in found[0]]
        for pos, w in proximity.neighbours(kept, ws, eos, dist, len(rare), c).items():
            yield int(row.docno), pos, w / norm

    spread = ranks.join(proximity.per_row(rows, near, "docno long, pos int, w double"), "docno").filter(_inside(F.col("pos")))
    parts = []
    for text in p["collect"] if isinstance(p["collect"], (list, tuple)) else [p["collect"]]:
        o = parse_collect(text)
        kinds = [x.strip().lower() for x in o.get("type", "orig").split(",")]
        hit = corpus.forward.filter(F.col("type").isin(kinds)).select("docno", "pos", F.col("value").alias("_v"))
        if o.get("tag"):
            allowed = corpus.forward.filter((F.col("type") == o["tag"].lower()) & F.col("value").isin([x for x in o.get("tags", "").split(",") if x])).select("docno", "pos")
            hit = hit.join(allowed, ["docno", "pos"], "left_semi")
        sums = spread.join(hit, ["docno", "pos"]).groupBy("docno", "fstart", "fend", "_v").agg(F.sum("w").alias("w"))
        k = F.row_number().over(Window.partitionBy("docno", "fstart", "fend").orderBy(F.round("w", 9).desc(), "_v"))
        parts.append(_out(sums.withColumn("_k", k).filter(F.col("_k") <= int(p["results"])), f"{id}:{o.get('name', 'near')}", F.col("_v"), F.col("w")))
    return functools.reduce(DataFrame.unionByName, parts)


@define("matchphrase", ("match", "punct"), text="orig", entity=None, dist_imm=2, dist_close=8, dist_near=40, dist_sentence=20, sentences=2, cluster=0.7, ffbase=0.1, maxdf=0.5)
def matchphrase(corpus, ranks, features, p, id):
    """The text of the best passage; entities stand in brackets before text that differs."""
    match = features.get("match") or []
    n_docs, c, n = corpus.n_docs(), config(p), len(match)
    dfs = weighting.dfs_of(corpus, match)
    rare = [i for i in range(n) if dfs[i] <= float(p["maxdf"]) * n_docs] or list(range(n))
    ws, sentences = [match[i][1] * weighting.idf(n_docs, dfs[i]) for i in rare], int(p["sentences"])
    rows = proximity.gathered(corpus, ranks.select("docno").distinct(), [match[i] for i in rare], features.get("punct", []))

    def best(row):
        found, eos = proximity.split(row.hits, len(rare))
        nodes = proximity.touches(found, eos, c, same_terms([match[i] for i in rare]))
        kept = (proximity.clustered(nodes, len(rare), c) if len(rare) > 1 else nodes) or nodes
        at = proximity.best_passage(kept, ws, eos, len(rare), c, sentences)
        if at:
            yield int(row.docno), at[0], at[1]

    spans = ranks.join(proximity.per_row(rows, best, "docno long, a int, b int"), "docno")
    text = corpus.forward.filter(F.col("type") == p["text"].lower()).select("docno", "pos", F.col("value").alias("_t"))
    got = spans.join(text, "docno").filter((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")))
    if p["entity"]:
        entity = corpus.forward.filter(F.col("type") == p["entity"].lower()).select("docno", "pos", F.col("value").alias("_e"))
        got = got.join(entity, ["docno", "pos"], "left").withColumn("_t", F.when(F.col("_e").isNotNull() & (F.col("_e") != F.col("_t")), F.concat(F.lit("["), "_e", F.lit("] "), "_t")).otherwise(F.col("_t")))
    phrase = got.groupBy("docno", "fstart", "fend", "a").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), " ").alias("_v"))
    return _out(phrase, id, F.col("_v"), None, F.col("a"))


@define("structheader", (), text="orig", struct=None)
def structheader(corpus, ranks, features, p, id):
    """Headings of the structures whose content covers the field, from the top down."""
    s = corpus.structures
    if p["struct"]:
        s = s.filter(F.col("struct") == p["struct"])
    over = ranks.filter("fend > fstart").join(s.select("docno", "struct", "hstart", "hend", "cstart", "cend"), "docno").filter((F.col("cstart") <= F.col("fstart")) & (F.col("cend") >= F.col("fend")) & ((F.col("hstart") != F.col("cstart")) | (F.col("hend") != F.col("cend"))))
    text = corpus.forward.filter(F.col("type") == p["text"].lower()).select("docno", "pos", "value")
    got = over.join(text, "docno").filter((F.col("pos") >= F.col("hstart")) & (F.col("pos") < F.col("hend")))
    heads = got.groupBy("docno", "fstart", "fend", "hstart", "hend", "cstart", "cend").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ").alias("_v"))
    k = F.row_number().over(Window.partitionBy("docno", "fstart", "fend").orderBy("cstart", F.col("cend").desc(), "hstart")) - 1
    return _out(heads.withColumn("_k", k), id, F.col("_v"), None, F.col("_k"))


def _of_weighting(name: str):
    def run(corpus, ranks, features, p, id):
        got = weighting.call(name, corpus, ranks.select("docno").distinct(), features, {k: v for k, v in p.items() if v is not None})
        rows = ranks.join(got.select("docno", "weight"), "docno")
        # -0.0 and 0.0 are written alike.
        weight = _out(rows, F.concat(F.lit(id), F.lit(":weight")) if id != name else F.lit("weight"), F.format_string("%.4f", F.col("weight") + F.lit(0.0)))
        field = rows.filter("fend > fstart")
        return weight.unionByName(_out(field, "start", F.col("fstart"))).unionByName(_out(field, "end", F.col("fend")))

    return run


define("smart", ("match",), function=None, metadata=())(_of_weighting("smart"))
define("scalar", (), function=None, metadata=())(_of_weighting("scalar"))


def global_summary(rows: DataFrame) -> DataFrame:
    """(name, value, weight): sums over ranks of whole documents, as shares of the largest sum of the name."""
    sums = rows.filter("fstart = 0 AND fend = 0").groupBy("name", "value").agg(F.sum("weight").alias("w"))
    most = sums.groupBy(F.col("name").alias("_n")).agg(F.max("w").alias("_m"))
    return sums.join(most, F.col("name") == F.col("_n")).select("name", "value", F.when(F.col("_m") != 0, F.col("w") / F.col("_m")).otherwise(0.0).alias("weight"))


def describe(name: str) -> dict:
    fn, defaults, roles = REGISTRY[name.lower()]
    return {"name": name.lower(), "features": list(roles), "parameters": dict(defaults), "doc": fn.__doc__ or ""}
