"""Proximity kernels of one document: touch counts, weighted frequencies, best passages, weighted neighbours and titles.

A document comes as features, each a list of (position, length), sentence delimiters, and structures.  Kernels are plain
Python on one document's query matches, so that their cost is bounded by what a query finds in a document; frames() runs
one per document over candidates that hold a feature.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import joins
from rankloom.sources.corpus import DELIMITERS, TOKEN


@dataclass
class Config:
    cluster: float = 0.7
    dist_imm: int = 2
    dist_close: int = 8
    dist_near: int = 40
    dist_sentence: int = 20
    ffbase: float = 0.1
    hotspots: int = 10


@dataclass
class Node:
    feature: int
    pos: int
    length: int
    #: Numbers of other features met first as immediate, close, in the sentence, near; and through a title.
    imm: int = 0
    close: int = 0
    same: int = 0
    near: int = 0
    title: int = 0

    def total(self) -> int:
        return self.imm + self.close + self.same + self.near + self.title


def min_cluster(n: int, cluster: float) -> int:
    return max(1, int(cluster * n + 0.5))


def occurrences(features: list[list[tuple[int, int]]], same: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(position, feature, length) in order.  Features that are the same term take its occurrences by turns."""
    out, group = [], defaultdict(list)
    for i, _ in enumerate(features):
        group[same[i] if same else i].append(i)
    for members in group.values():
        for k, (p, n) in enumerate(sorted(features[members[0]])):
            out.append((p, members[k % len(members)], n))
    return sorted(out)


def touches(features, eos: list[int], c: Config, same: list[int] | None = None) -> list[Node]:
    """Nodes with the other features that each meets, every pair counted once, in the first class that reaches it."""
    found = occurrences(features, same)
    nodes = [Node(f, p, n) for p, f, n in found]
    eos = sorted(eos)
    classes = [("imm", c.dist_imm, True), ("close", c.dist_close, True), ("same", c.dist_sentence, True), ("near", c.dist_near, False)]
    if not eos:
        classes = [x for x in classes if x[0] != "same"]
    met: list[set[int]] = [set() for _ in nodes]
    for name, dist, stops in classes:
        for i, a in enumerate(nodes):
            end = a.pos + a.length
            stop = eos[k] if stops and (k := bisect.bisect_left(eos, a.pos)) < len(eos) else None
            for j in range(i + 1, len(nodes)):
                b = nodes[j]
                if end + dist <= b.pos or (stop is not None and b.pos > stop):
                    break
                if b.feature == a.feature:
                    continue
                if b.feature not in met[i]:
                    met[i].add(b.feature)
                    setattr(a, name, getattr(a, name) + 1)
                if a.feature not in met[j]:
                    met[j].add(a.feature)
                    setattr(b, name, getattr(b, name) + 1)
    return nodes


def clustered(nodes: list[Node], n: int, c: Config) -> list[Node]:
    least = min_cluster(n, c.cluster)
    return [x for x in nodes if x.total() >= least]


def ff_weight(x: Node, n: int, c: Config) -> float:
    if n < 2:
        return 1.0
    q = lambda k: k * k / ((n - 1) * (n - 1))
    imm = x.imm
    close = imm + x.close
    same = close + x.same
    near = same + x.near + x.title
    if near < min_cluster(n, c.cluster):
        return 0.0
    ww = (1.0 if imm > 0 else 0.0) + q(close) + q(same) + q(near)
    return (1 - c.ffbase) * ww / 4 + c.ffbase


def best_passage(nodes: list[Node], weights: list[float], eos: list[int], n: int, c: Config, sentences: int = 2) -> tuple[int, int] | None:
    """The window of sentences * dist_sentence positions with the largest sum of weights, drawn out to whole sentences."""
    if not nodes:
        return None
    span = sentences * c.dist_sentence
    best, at, end = -1.0, 0, 0
    for i, a in enumerate(nodes):
        total, j = 0.0, i
        while j < len(nodes) and nodes[j].pos < a.pos + span:
            total += weights[nodes[j].feature] * ff_weight(nodes[j], n, c)
            j += 1
        if total > best + 1e-12:
            best, at, end = total, a.pos, nodes[j - 1].pos + nodes[j - 1].length
    eos = sorted(eos)
    k = bisect.bisect_left(eos, at)
    start = eos[k - 1] + 1 if k and at - eos[k - 1] <= c.dist_sentence else max(1, at)
    k = bisect.bisect_left(eos, end)
    stop = eos[k] if k < len(eos) and eos[k] - end <= c.dist_sentence else end
    return start, stop


def neighbours(nodes: list[Node], weights: list[float], eos: list[int], dist: int, n: int, c: Config) -> dict[int, float]:
    """Weights of the positions around matches, added up; a sentence's end stops the spread."""
    eos, out = sorted(eos), defaultdict(float)
    for x in nodes:
        w = weights[x.feature] * ff_weight(x, n, c)
        k = bisect.bisect_left(eos, x.pos)
        low = max(1, x.pos - dist, eos[k - 1] + 1 if k else 1)
        high = min(x.pos + x.length - 1 + dist, eos[k] - 1 if k < len(eos) else x.pos + x.length - 1 + dist)
        for p in range(low, high + 1):
            out[p] += w
    return dict(out)


@dataclass
class Field:
    struct: str
    hstart: int
    hend: int
    cstart: int
    cend: int


def field_frequencies(nodes: list[Node], n: int, features: int, c: Config, fields: list[Field], struct: str | None = None) -> dict[tuple[int, int], list[float]]:
    """Sums of weighted frequencies by feature, for the whole document as (0, 0) and for the contents of structures that
    hold one of the nodes with most touches; nodes in a content meet the features of its header as well."""
    chosen = [f for f in fields if not struct or f.struct == struct]
    nodes = sorted(nodes, key=lambda x: x.pos)
    at = [x.pos for x in nodes]
    # A field's nodes are a run of them: what a field costs is what it holds.
    within = lambda a, b: nodes[bisect.bisect_left(at, a) : bisect.bisect_left(at, b)]
    for f in chosen:
        if (f.hstart, f.hend) == (f.cstart, f.cend):
            continue
        head = {x.feature for x in within(f.hstart, f.hend)}
        if head:
            for x in within(f.cstart, f.cend):
                x.title = max(x.title, len(head - {x.feature}))
    weights = [ff_weight(x, n, c) for x in nodes]

    def sums(a: int, b: int) -> list[float]:
        out = [0.0] * features
        for k in range(a, b):
            out[nodes[k].feature] += weights[k]
        return out

    out = {(0, 0): sums(0, len(nodes))}
    hot = sorted(x.pos for x in sorted(nodes, key=lambda x: (-x.total(), x.pos))[: c.hotspots])
    for f in chosen:
        k = bisect.bisect_left(hot, f.cstart)
        if k < len(hot) and hot[k] < f.cend:
            out[f.cstart, f.cend] = sums(bisect.bisect_left(at, f.cstart), bisect.bisect_left(at, f.cend))
    return out


def title_matches(features: list[list[tuple[int, int]]], fields: list[Field], hf: float, stop: list[bool], results: int) -> list[tuple[int, int, float]]:
    """Contents whose headings are covered by the features in their order: (start, end, weight), best first."""
    n = len(features)
    if not n or any(not f for f in features):
        return []
    at = [dict(f) for f in features]
    runs: dict[tuple[int, int], list[tuple[int, int, bool]]] = defaultdict(list)
    heads = {}
    for f in fields:
        if f.hend - f.hstart <= 64:
            heads.setdefault((f.hstart, f.hend), []).append(f)
    for (hs, he), _ in heads.items():
        for first in range(n):
            if hs not in at[first]:
                continue
            p, k = hs, first
            while k < n and p < he and p in at[k]:
                p += at[k][p]
                k += 1
                runs[hs, he].append((first, k, p >= he))
    contents = sorted({(f.cstart, f.cend) for f in fields})
    # Only headings that some run of features starts can matter; contents of other structures that cover them are counted.
    deep = {}
    for h in runs:
        own = {(f.cstart, f.cend) for f in heads[h]}
        deep[h] = sum(1 for c in contents[: bisect.bisect_right(contents, (h[0], 1 << 60))] if h[1] <= c[1] and c not in own)
    best: dict[tuple[int, int], float] = {}
    queue = []
    for h, rs in runs.items():
        if deep[h]:
            continue
        for a, b, complete in rs:
            for f in heads[h]:
                if (a, b) == (0, n):
                    best[f.cstart, f.cend] = max(best.get((f.cstart, f.cend), 0), 1.0)
                elif complete:
                    queue.append((frozenset(range(a, b)), (f.cstart, f.cend), 0, (b - a) / n))
    while queue:
        used, content, level, weight = queue.pop()
        for h, rs in runs.items():
            if deep[h] <= level or not (content[0] <= h[0] and h[1] <= content[1]):
                continue
            for a, b, complete in rs:
                mine = frozenset(range(a, b))
                if mine & used:
                    continue
                total = weight + (b - a) / n * hf ** deep[h]
                for f in heads[h]:
                    if len(used | mine) == n and (complete or not all(stop[k] for k in mine)):
                        best[f.cstart, f.cend] = max(best.get((f.cstart, f.cend), 0), total)
                    elif complete:
                        queue.append((used | mine, (f.cstart, f.cend), deep[h], total))
    return [(s, e, w) for (s, e), w in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:results]]


def gathered(corpus, candidates: DataFrame, match: list, punct: list, fields: bool = False, extra: list[str] = ()) -> DataFrame:
    """docno, hits (arrays of feature, position, length; delimiters have feature -1), structures and metadata per candidate."""
    rows = joins._marked([e.compile(corpus) for e, _ in match], [e.compile(corpus) for e, _ in punct])
    found = rows.select("docno", F.col("arg").alias("f"), "pos", "len").join(candidates.select("docno"), "docno", "left_semi")
    # One row per document: what a query finds in it, bounded by the document's length.
    out = found.groupBy("docno").agg(F.collect_list(F.struct("f", "pos", "len")).alias("hits")).filter(F.exists("hits", lambda h: h["f"] >= 0))
    if fields:
        s = corpus.structures.groupBy("docno").agg(F.collect_list(F.struct("struct", "hstart", "hend", "cstart", "cend")).alias("fields"))
        out = out.join(s, "docno", "left")
    if extra:
        out = out.join(corpus.metadata.select("docno", *extra), "docno", "left")
    return out


def split(hits, n: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    features: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    eos = []
    for h in hits:
        if h["f"] < 0:
            eos.append(int(h["pos"]))
        else:
            features[h["f"]].append((int(h["pos"]), int(h["len"])))
    return [sorted(set(f)) for f in features], sorted(set(eos))


def read(corpus, candidates: DataFrame, match: list, punct: list, key: str) -> tuple[DataFrame, Callable]:
    """A row per candidate, and what gives occurrences by feature, delimiters, structures and the metadata `key` of a row; of
    one that no feature matches, nothing.  Where the tables are computed from texts and the features are their terms, a row is
    a candidate's text, and all of this is found in it: nothing but texts is moved, once."""
    n = len(match)
    terms = [(i, e) for i, (e, _) in enumerate(match)] + [(-1, e) for e, _ in punct]
    texts = corpus.texts()
    if texts is None or not all(isinstance(getattr(e, "value", None), str) and e.type.lower() in ("word", "eos") for _, e in terms):
        # Candidates without a feature have a row without hits, so that what is found is computed once.
        rows = candidates.select("docno").join(gathered(corpus, candidates, match, punct, True, [key]), "docno", "left")

        def of_hits(row):
            if row.hits is None:
                return None
            fields = [Field(f["struct"], int(f["hstart"]), int(f["hend"]), int(f["cstart"]), int(f["cend"])) for f in (row.fields if row.fields is not None else [])]
            return *split(row.hits, n), fields, float(getattr(row, key) or 0)

        return rows, of_hits
    rows = texts.join(candidates.select("docno").hint("shuffle_hash"), "docno", "left_semi")
    counted = key == "doclen" and corpus.metadata is corpus.built_metadata()
    if not counted:
        rows = rows.join(corpus.metadata.select("docno", key), "docno", "left")
    wanted: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for i, e in terms:
        for t in (DELIMITERS if e.value == "" else ()) if e.type.lower() == "eos" else (e.value,) if e.value not in DELIMITERS else ():
            wanted[t.encode()].append((i, e.length))
    token, ends = re.compile(TOKEN.encode()), frozenset(t.encode() for t in DELIMITERS)

    def of_text(row):
        # Tokens are ASCII, and so is the lower case of bytes.
        tokens = token.findall((row.text or b"").lower())
        features: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        eos, stops = [], []
        for pos, t in enumerate(tokens, 1):
            if t in ends:
                stops.append(pos)
            if t in wanted:
                for i, length in wanted[t]:
                    if i < 0:
                        eos.append(pos)
                    else:
                        features[i].append((pos, length))
        if not any(features):
            return None
        return [sorted(set(f)) for f in features], sorted(set(eos)), fields_of(stops, len(tokens)), float(len(tokens) - len(stops) if counted else getattr(row, key) or 0)

    return rows, of_text


def fields_of(stops: list[int], last: int) -> list[Field]:
    """The structures of a text by the places of its delimiters and its last place: those of `corpus.structures`."""
    ends = [*stops, last + 1]
    title = [Field("title", 1, stops[0], stops[0], last + 1)] if stops and stops[0] > 1 else []
    return title + [Field("sentence", a + 1, b, a + 1, b) for a, b in zip([0, *stops], ends) if a + 1 < b]


def per_row(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn makes rows of a document's row."""
    import pyspark.sql.types as T

    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(frames):
        for pdf in frames:
            rows = [out for row in pdf.itertuples(index=False) for out in fn(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)
