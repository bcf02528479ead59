"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over the words and word beginnings that a text holds learns from confirmed toxic texts and from unlabelled texts
of the whole table.  The risk is corrected for the class prior p: p * (mean loss of positives as positive) plus the
mean loss of the unlabelled as negative less p * (mean loss of positives as negative), where the second part may not go
below zero; when it does, the step is taken against it (the non-negative estimator).  The prior is the share of toxic
rows among the labels of the training folds.

What is sampled: at most `positives` toxic and `unlabelled` other texts, those of least hash of id, for fitting only; of
texts that repeat an id one.  Features are counted and chosen by Spark; only the chosen ones of each sampled text come to the
driver, whatever its length.  A feature must be held by `least` of the sampled toxic texts and by a `share` of them (0.025),
so toxic texts whose only telling words are rarer than that are not found.

All rows are scored, over whole texts.  Defined results: null and empty texts score as a text without known words;
rows without a usable label are unlabelled; without any toxic training row every score is 0; ids are cast to longs; equal
rows score alike; an empty table gives no rows; other columns may have any name and are handed through by keep_clean().
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common
from rankloom.llm._pieces import Memo

_WORD = re.compile(r"[^\W\d_]+")
_HASH = 1 << 22


def _features(tokens: list[str]) -> list[bytes]:
    """Numbers of the words in each token and of their first four and five letters, so that endings don't hide a stem."""
    out = []
    for token in tokens:
        names = [x for w in _WORD.findall(token) for x in [w] + [f"{w[:k]}-{k}" for k in (4, 5) if len(w) >= k]]
        out.append(np.array([zlib.crc32(x.encode()) % _HASH for x in names], np.int32).tobytes())
    return out


def memo() -> Memo:
    """What tokens are made of, remembered in bounded memory."""
    return Memo(_features, 24 << 20)


def numbers(texts: list[str | None], known: Memo) -> list[np.ndarray]:
    """The distinct features of whole texts, in order."""
    tokens = [set((x or "").lower().split()) for x in texts]
    get = known.table(set().union(*tokens)).__getitem__
    return [np.unique(np.frombuffer(b"".join(map(get, x)), np.int32)) for x in tokens]


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """doc_id, y (1: toxic) and h (features) of the sampled texts, and the prior.  Labels of the held-out fold are not read."""
    train = labels.filter(~_common.fold_held_out()).filter(F.col("toxic").isNotNull())
    stats = train.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    order = F.xxhash64("doc_id")
    toxic = train.filter(F.col("toxic") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(order, "doc_id").limit(positives).withColumn("y", F.lit(1))
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~_common.fold_held_out() & F.col("doc_id").isNotNull()).distinct().orderBy(order, "doc_id").limit(unlabelled).withColumn("y", F.lit(0))
    # Both sides are bounded by the two parameters, so their ids may be sent to every task.
    wanted = toxic.unionByName(others)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        known = memo()
        for b in _common.slices(batches, "text"):
            found = numbers(b.column(2).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))], names=["doc_id", "y", "h"])

    rows = _common.map_batches(texts, run, "doc_id long, y int, h array<int>").groupBy("doc_id", "y").agg(F.min("h").alias("h"))
    return _common.cut(rows, "sampled"), float(stats or 0.0)


def telling(counts: np.ndarray, among: np.ndarray, n_pos: int, n_un: int, prior: float, least: int = 4, share: float = 0.025) -> np.ndarray:
    """Which features are kept, by how many sampled toxic and other texts hold each."""
    prior = min(max(prior, 0.01), 0.9)
    # A word that only toxic texts hold is 1 / prior times as frequent among positives as among the unlabelled.
    p_rate, u_rate = (counts + 0.5) / (n_pos + 1), (among + 0.5) / (n_un + 1)
    by_chance = n_pos * u_rate
    return (counts >= min(max(least, share * n_pos), n_pos)) & (p_rate > 0.4 / prior * u_rate) & (counts - by_chance > 5 * np.sqrt(by_chance))


class Model:
    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: float):
        self.columns, self.weights, self.bias = columns, weights, bias

    def score(self, h: np.ndarray) -> float:
        """0 to 1 from a text's hashed words, each counted once."""
        if len(self.columns) and len(h):
            at = np.searchsorted(self.columns, h)
            at[at == len(self.columns)] = 0
            z = self.bias + float(self.weights[at[self.columns[at] == h]].sum())
        else:
            z = self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[np.ndarray], positive: np.ndarray, prior: float, least: int = 4, share: float = 0.025, epochs: int = 400, rate: float = 0.05, decay: float = 3e-4) -> Model:
    """Adam on the non-negative risk with the logistic loss; features that fewer than `least` positives, or a smaller share of them, hold are left out."""
    prior = min(max(prior, 0.01), 0.9)
    none = Model(np.empty(0, np.int32), np.empty(0), -30.0)
    if not positive.any():
        return none
    inside = np.concatenate([t for t, p in zip(texts, positive) if p] or [np.empty(0, np.int32)])
    words, counts = np.unique(inside, return_counts=True)
    n_pos, n_un = int(positive.sum()), int((~positive).sum())
    flat = np.concatenate([t for t, p in zip(texts, positive) if not p] or [np.empty(0, np.int32)])
    u_words, u_counts = np.unique(flat, return_counts=True)
    among = np.zeros(len(words))
    if len(u_words):
        at = np.minimum(np.searchsorted(u_words, words), len(u_words) - 1)
        among = np.where(u_words[at] == words, u_counts[at], 0)
    keep = telling(counts, among, n_pos, n_un, prior, least, share)
    columns = words[keep].astype(np.int32)
    if not len(columns):
        return none
    doc, col = [], []
    for k, t in enumerate(texts):
        at = np.minimum(np.searchsorted(columns, t), len(columns) - 1)
        hit = at[columns[at] == t]
        doc.append(np.full(len(hit), k))
        col.append(hit)
    doc, col = np.concatenate(doc), np.concatenate(col)
    n, m = len(texts), len(columns)
    w, b = np.zeros(m + 1), 0.0
    w[m] = b
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    pos, un = positive, ~positive
    for e in range(1, epochs + 1):
        z = np.bincount(doc, w[col], minlength=n) + w[m]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative_risk = np.logaddexp(0, z[un]).mean() - prior * np.logaddexp(0, z[pos]).mean() if n_un else 0.0
        g = np.zeros(n)
        if negative_risk >= 0:
            g[pos] = prior * (s[pos] - 1) / n_pos - prior * s[pos] / n_pos
            g[un] = s[un] / max(n_un, 1)
        else:
            g[pos] = prior * s[pos] / n_pos
            g[un] = -s[un] / max(n_un, 1)
        grad = np.append(np.bincount(col, g[doc], minlength=m), g.sum())
        grad[:m] += decay * w[:m]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w -= rate * (m1 / (1 - 0.9**e)) / (np.sqrt(m2 / (1 - 0.999**e)) + 1e-8)
    # A text without any telling feature is no likelier toxic than the prior says.
    return Model(columns, w[:m], min(float(w[m]), float(np.log(prior / (1 - prior)))))


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 20_000, least: int = 4, share: float = 0.025) -> Model:
    rows, prior = sample(docs, labels, positives, unlabelled)
    many = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_un = many.get(1, 0), many.get(0, 0)
    # Features of fewer toxic texts are out whatever else holds; what is left is at most a mean text's features / share.
    enough = min(max(least, share * n_pos), n_pos)
    held = rows.select("y", F.explode("h").alias("w")).groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u")).filter(F.col("p") >= max(1, enough))
    found = np.array([(r["w"], r["p"], r["u"]) for r in held.collect()], np.int64).reshape(-1, 3)
    columns = np.sort(found[telling(found[:, 1], found[:, 2], n_pos, n_un, prior, least, share), 0]).astype(np.int32)

    def run(batches):
        for b in batches:
            h = b.column(2)
            at, flat = h.offsets.to_numpy(), h.values.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.intersect1d(flat[x:y], columns).astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "y", "h"])

    got = sorted(_common.map_batches(rows, run, "doc_id long, y int, h binary").collect(), key=lambda r: (-r.y, r.doc_id, r.h))
    _common.discard(rows)
    return fit([np.frombuffer(r.h, np.int32) for r in got], np.array([r.y for r in got], bool), prior, least, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches):
        known = memo()
        for b in _common.slices(batches, "text"):
            found = [model.score(h) for h in numbers(b.column(1).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return _common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of documents that score below the threshold, with the columns they came with."""
    names = docs.columns

    def run(batches):
        known = memo()
        for b in _common.slices(batches, "text"):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([model.score(h) < threshold for h in numbers(texts, known)], pa.bool_()))

    return _common.map_batches(docs.select(*names), run, docs.schema)
