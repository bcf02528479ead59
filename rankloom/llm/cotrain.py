"""Quality classification by co-training of two views.

One classifier sees what a text holds (shares of kinds of characters, repeated words and lines, lengths of words), the
other what is recorded about it (source, language, length).  Both are logistic regressions in numpy.  They start from
labelled rows; in each round each view labels the unlabelled texts that it is surest of, as many good as bad ones by the
labels' shares, and hands them to the other view, which is fitted again.  At the end each view is calibrated (Platt) on a
labelled part that neither was fitted on, and the calibrated views are added up as log odds, less the prior counted twice.

What is sampled: at most `labelled` labelled and `pool` unlabelled rows, those of least hash of id, for fitting only; all
rows are scored, over whole texts.  Labels of the held-out fold are never read.  Defined results: null and empty texts have
the features zero; a null source, language or length counts as a value of its own; without labels of both classes every
score is the share of good labels, or 1 without any; of rows that repeat an id one is fitted on, and each is scored; ids are
cast to longs; an empty table gives no rows; other columns may have any name and are handed through by keep_good().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common

_KINDS = np.full(256, 9)
for _chars, _k in ((b" ", 0), (b"\n", 1), (bytes(range(97, 123)), 2), (bytes(range(65, 91)), 3), (b"0123456789", 4), (b".,;:?'\"-", 5), (b"!", 6), (b"#$%&*@^~<>{}[]\\/=+_", 7), (b"|", 8)):
    for _c in _chars:
        _KINDS[_c] = _k
_KINDS[128:] = 10
TEXT_FEATURES = 11 + 7
META_BUCKETS = 64
META_FEATURES = 2 * META_BUCKETS + 2


def text_features(text: str | None) -> np.ndarray:
    out = np.zeros(TEXT_FEATURES)
    if not text:
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    out[:11] = np.sqrt(np.bincount(_KINDS, np.bincount(data, minlength=256), minlength=11) / len(data))
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    out[11] = sum(map(str.isupper, words)) / n
    out[12] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[13] = len(set(words)) / n
    out[14] = 1 - len(set(lines)) / len(lines)
    out[15] = min(len(text) / n, 30) / 10
    out[16] = np.log1p(n) / 10
    out[17] = np.log1p(len(lines)) / 10
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_FEATURES)
    out[zlib.crc32(f"s{source}".encode()) % META_BUCKETS] = 1
    out[META_BUCKETS + zlib.crc32(f"l{lang}".encode()) % META_BUCKETS] = 1
    out[-2] = np.log1p(max(0, n_chars or 0)) / 10
    out[-1] = n_chars is None
    return out


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def __init__(self, ridge: float = 1.0, turns: int = 12):
        self.ridge, self.turns = ridge, turns

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        keep = np.append(np.full(z.shape[1] - 1, self.ridge), 1e-3)
        for _ in range(self.turns):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep)
            w -= np.linalg.solve(h, z.T @ (p - y) + keep * w)
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1], -30, 30)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, not negative, and offset of log odds; targets are drawn in as Platt does."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, r = p - t, p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        a, b = a - da, b - db
    return (float(a), float(b)) if a >= 0 else (0.0, float(np.log((up + 1) / (down + 1))))


class CoTrained:
    """Both calibrated views; score() is the chance that a row is good."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text)
        if self.constant is not None or not n:
            c = np.full(n, 1.0 if self.constant is None else self.constant)
            return c, c, c
        both = [a * m.logit(x) + b for (a, b), m, x in zip(self.platt, self.views, (text, meta))]
        s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return s(both[0]), s(both[1]), s(both[0] + both[1] - self.prior)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = 5, share: float = 0.05, seed: int = 7) -> CoTrained:
    """y: 1 good, 0 bad, -1 unlabelled."""
    known = y >= 0
    if not known.any() or len(set(y[known].tolist())) < 2:
        return CoTrained(float(y[known].mean()) if known.any() else 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(np.flatnonzero(known))
    aside = order[: len(order) // 4]
    if len(set(y[aside].tolist())) < 2:
        aside = order
    fit_rows = np.setdiff1d(order, aside) if len(aside) < len(order) else order
    if len(set(y[fit_rows].tolist())) < 2:
        fit_rows = order
    good = float(y[fit_rows].mean())
    # What each view has been given: its own labels and those that the other view was sure of.
    given = [y.copy(), y.copy()]
    for g in given:
        g[np.setdiff1d(np.flatnonzero(known), fit_rows)] = -1
    inputs = (text, meta)
    views = [Logistic().fit(x[fit_rows], y[fit_rows].astype(float)) for x in inputs]
    pool = np.flatnonzero(~known)
    for _ in range(rounds):
        if not len(pool):
            break
        for me, other in ((0, 1), (1, 0)):
            free = pool[given[other][pool] < 0]
            if not len(free):
                continue
            z = views[me].logit(inputs[me][free])
            by = np.argsort(z, kind="stable")
            most = max(1, int(share * len(free)))
            bad = by[: max(1, int(most * (1 - good)))]
            top = by[::-1][: max(1, int(most * good))]
            # Only what is surer than nine in ten is handed over.
            bad, top = bad[z[bad] < -2.2], top[z[top] > 2.2]
            given[other][free[bad]] = 0
            given[other][free[top]] = 1
        for v in (0, 1):
            rows = np.flatnonzero(given[v] >= 0)
            views[v] = Logistic().fit(inputs[v][rows], given[v][rows].astype(float))
    out = CoTrained()
    out.views = views
    out.platt = [_platt(v.logit(x[aside]), y[aside].astype(float)) for v, x in zip(views, inputs)]
    out.prior = float(np.log((y[aside].sum() + 1) / ((1 - y[aside]).sum() + 1)))
    return out


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    return np.array([text_features(x) for x in text]).reshape(-1, TEXT_FEATURES), np.array([meta_features(*x) for x in zip(source, lang, n)]).reshape(-1, META_FEATURES)


def train(docs: DataFrame, labels: DataFrame, labelled: int = 8000, pool: int = 8000, rounds: int = 5) -> CoTrained:
    usable = labels.filter(~_common.fold_held_out() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~_common.fold_held_out())
    wanted = usable.orderBy(order, "doc_id").limit(labelled).unionByName(ids.join(usable, "doc_id", "left_anti").distinct().orderBy(order, "doc_id").limit(pool).withColumn("y", F.lit(-1)))
    # Bounded by the two parameters, so it may be sent to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(wanted), "doc_id")

    def run(batches):
        for b in _common.slices(batches, "text"):
            t, m = _features(b)
            both = np.c_[t, m].astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("y")), pa.array([x.tobytes() for x in both], pa.binary())], names=["doc_id", "y", "x"])

    # One row of each id, so that ids that repeat send no more to the driver.
    once = _common.map_batches(rows, run, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x")
    got = sorted(once.collect(), key=lambda r: (r.doc_id, r.x))
    if not got:
        return CoTrained(1.0)
    x = np.stack([np.frombuffer(r.x, "<f4") for r in got]).astype(float)
    return co_train(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:], np.array([r.y for r in got]), rounds)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_text, p_meta and score of every row."""

    def run(batches):
        for b in _common.slices(batches, "text"):
            t, m, s = model.score(*_features(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(m), pa.array(s)], names=["doc_id", "p_text", "p_meta", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return _common.map_batches(rows, run, "doc_id long, p_text double, p_meta double, score double")


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """The rows that score at least the threshold, with the columns they came with."""

    def run(batches):
        for b in _common.slices(batches, "text"):
            yield b.filter(pa.array(model.score(*_features(b))[2] >= threshold))

    return _common.map_batches(docs, run, docs.schema)
