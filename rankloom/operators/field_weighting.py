"""Weighting functions that give fields of documents: bm25pff and title."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import proximity
from rankloom.operators.weighting import _need, define, dfs_of, idf

OUT = "docno long, fstart int, fend int, weight double"


def same_terms(features: list) -> list[int]:
    """Features that are the same expression share occurrences: the number of the first of them."""
    seen: dict = {}
    return [seen.setdefault(repr(e.view()), i) for i, (e, _) in enumerate(features)]


def config(p) -> proximity.Config:
    return proximity.Config(**{k: type(v)(p[k]) for k, v in proximity.Config().__dict__.items() if k in p})


@define("bm25pff", ("match", "punct"), struct=None, k1=1.5, b=0.75, avgdoclen=500.0, maxdf=0.5, results=0, dist_imm=2, dist_close=8, dist_near=40, dist_sentence=20, cluster=0.7, hotspots=10, ffbase=0.1, metadata_doclen="doclen")
def bm25pff(corpus, candidates, features, p):
    """BM25 over frequencies that are weighted by what stands near, per structure field and for the whole document."""
    match = _need(features, "match")
    n_docs, k1, b, avg = corpus.n_docs(), float(p["k1"]), float(p["b"]), float(p["avgdoclen"])
    dfs = dfs_of(corpus, match)
    common = [d > float(p["maxdf"]) * n_docs for d in dfs]
    ws = [w * idf(n_docs, d) for (_, w), d in zip(match, dfs)]
    same, c, n, struct, key = same_terms(match), config(p), len(match), p["struct"], p["metadata_doclen"]
    rare = [i for i in range(n) if not common[i]]
    rows, found_in = proximity.read(corpus, candidates, match, features.get("punct", []), key)

    def score(row):
        got = found_in(row)
        if got is None:
            yield int(row.docno), 0, 0, 0.0
            return
        found, eos, fields, doclen = got
        plain = [float(len(f)) for f in found]
        per_field = {(0, 0): plain}
        if len(rare) > 1:
            nodes = proximity.touches([found[i] for i in rare], eos, c, [rare.index(same[i]) if same[i] in rare else k for k, i in enumerate(rare)])
            kept = proximity.clustered(nodes, len(rare), c)
            per_field = proximity.field_frequencies(kept, len(rare), len(rare), c, fields, struct)
            per_field = {k: [dict(zip(rare, v)).get(i, 0.0) for i in range(n)] for k, v in per_field.items()}
        for (s, e), ff in per_field.items():
            size = float(e - s) if e > s else doclen
            total = 0.0
            for i in range(n):
                f = ff[i]
                if common[i] and len(rare) > 1:
                    f = plain[i] * (size / doclen if doclen else 1.0)
                if f > 0:
                    total += ws[i] * f * (k1 + 1) / (f + k1 * (1 - b + b * size / avg if b else 1.0))
            yield int(row.docno), s, e, total

    return proximity.per_row(rows, score, OUT)


@define("title", ("match",), hf=0.7, results=5, maxdf=1.0)
def title(corpus, candidates, features, p):
    """Contents under headings that the features cover in order."""
    match = _need(features, "match")
    n, hf, results = len(match), float(p["hf"]), int(p["results"])
    stop = [d > float(p["maxdf"]) * corpus.n_docs() for d in dfs_of(corpus, match)]
    rows = proximity.gathered(corpus, candidates, match, [], True)

    def score(row):
        found, _ = proximity.split(row.hits, n)
        fields = [proximity.Field(f["struct"], int(f["hstart"]), int(f["hend"]), int(f["cstart"]), int(f["cend"])) for f in (row.fields if row.fields is not None else [])]
        for s, e, w in proximity.title_matches(found, fields, hf, stop, results):
            yield int(row.docno), s, e, w

    return proximity.per_row(rows, score, OUT)
