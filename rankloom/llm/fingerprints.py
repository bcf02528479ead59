"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the high bits choose one of the bins and the low bits are its value, of which each
bin keeps the least.  Empty bins are filled by optimal densification: bin i asks bins h(i, 1), h(i, 2), ... of a fixed
random sequence until one is filled and takes its value, so that equal sets borrow alike.  Of each value the lowest bits
are kept, packed, and written as hexadecimal digits.  The likeness of two fingerprints is the share of equal bins, less
what chance makes equal: (share - 2^-b) / (1 - 2^-b), at least 0.

Words are what white space of ASCII separates, lower-cased from A to Z; a text of fewer words is one shingle.  Defined
results: null, empty and blank texts have the fingerprint "" (no shingle); two of those are alike with 1, one of those
and any other with 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common

_LOWER = bytes(range(256)).lower()
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class OnePermutation:
    """bins: a power of two; bits: 1, 2, 4 or 8 kept of each bin."""

    def __init__(self, bins: int = 512, bits: int = 4, words: int = 5, seed: int = 42):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.words, self.seed = bins, bits, words, seed
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.known: dict[bytes, int] = {}
        self.asked = np.empty((0, bins), np.int32)
        #: Equal places of a byte by what differs in it.
        self.equal = np.array([sum(d >> k & ((1 << bits) - 1) == 0 for k in range(0, 8, bits)) for d in range(256)])

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            x = xxhash.xxh64_intdigest
            for w in words:
                if w not in known:
                    known[w] = x(w, self.seed)
            return np.array([known[w] for w in words], np.uint64)

    def combined(self, h: np.ndarray) -> np.ndarray:
        """A hash of each shingle: word hashes combined by place, then mixed."""
        k = min(self.words, len(h))
        if not k:
            return h
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out *= _STEP
            out += h[i : len(h) - k + 1 + i]
        return _mix(out + np.uint64(k))

    def shingles(self, text: str | None) -> np.ndarray:
        return self.combined(self.word_hashes((text or "").encode().translate(_LOWER).split()))

    def values(self, hashes: np.ndarray) -> np.ndarray | None:
        """The least value of each bin, empty bins densified; None without shingles."""
        if not len(hashes):
            return None
        none = np.uint64(2**64 - 1)
        # Sorted, the hashes of a bin stand together, the least first.
        h = np.sort(hashes)
        at = (h >> self.shift).astype(np.int64)
        starts = np.empty(len(at), bool)
        starts[0] = True
        np.not_equal(at[1:], at[:-1], out=starts[1:])
        first = starts.nonzero()[0]
        width = np.uint64(self.bins.bit_length() - 1)
        got = np.full(self.bins, none, np.uint64)
        got[at[first]] = h[first] << width >> width
        filled = got != none
        todo = np.flatnonzero(~filled)
        share = len(first) / self.bins
        turn = 0
        while len(todo):
            # As many turns at once as leave few bins, then the rest.
            step = min(64, max(2, int(-3 / np.log1p(-share)) + 1)) if share < 1 else 2
            ask = self.turns(turn + step)[turn : turn + step].take(todo, axis=1)
            hit = filled.take(ask)
            best = hit.argmax(axis=0)
            flat = best * len(todo) + np.arange(len(todo))
            ok = hit.ravel().take(flat)
            got[todo[ok]] = got.take(ask.ravel().take(flat[ok]))
            todo = todo[~ok]
            turn += step
        return got

    def turns(self, n: int) -> np.ndarray:
        """Whom each bin asks in each turn of densification, for at least n turns."""
        if len(self.asked) < n:
            k = np.arange(1, 2 * n + 1, dtype=np.uint64)[:, None]
            every = np.arange(self.bins, dtype=np.uint64) * _STEP + (k * np.uint64(0x51ED27) + np.uint64(self.seed))
            self.asked = (_mix(every) & np.uint64(self.bins - 1)).astype(np.int32)
        return self.asked

    def packed(self, values: np.ndarray | None) -> bytes:
        if values is None:
            return b""
        low = (_mix(values) & np.uint64((1 << self.bits) - 1)).astype(np.uint8).reshape(-1, 8 // self.bits)
        out = low[:, 0].copy()
        for k in range(1, low.shape[1]):
            out = out << np.uint8(self.bits) | low[:, k]
        return out.tobytes()

    def __call__(self, text: str | None) -> str:
        return self.packed(self.values(self.shingles(text))).hex()

    def likeness(self, a: str, b: str) -> float:
        return self.likeness_of_bytes(bytes.fromhex(a), bytes.fromhex(b))

    def likeness_of_bytes(self, a: bytes, b: bytes) -> float:
        if not a or not b:
            return float(a == b)
        equal = int(self.equal[np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)].sum())
        chance = 2.0**-self.bits
        return max(0.0, (equal / self.bins - chance) / (1 - chance))


class Hashed:
    """A text's lower-cased bytes and the hashes of its words."""

    def __init__(self, one: OnePermutation, text: str):
        self.data = text.encode().translate(_LOWER)
        self.hashes = one.word_hashes(self.data.split())


def spliced(one: OnePermutation, head: Hashed, head_bytes: int, tail: Hashed, tail_bytes: int) -> np.ndarray:
    """Word hashes of the first bytes of one text followed by the first of another; only words at the cuts are hashed."""
    a, b = head.data[:head_bytes], tail.data[:tail_bytes]
    na, nb = len(a.split()), len(b.split())
    space = b" \t\n\r\x0b\x0c"
    whole_a = na - (na > 0 and a[-1] not in space and not (head_bytes == len(head.data) or head.data[head_bytes] in space))
    whole_b = nb - (nb > 0 and b[-1] not in space and not (tail_bytes == len(tail.data) or tail.data[tail_bytes] in space))
    first_b = 0
    if na and nb and a[-1] not in space and b[0] not in space:
        # The last word of the head and the first of the tail are one.
        middle = a.rsplit(None, 1)[-1] + b.split(None, 1)[0]
        whole_a, first_b = na - 1, 1
        parts = [head.hashes[:whole_a], one.word_hashes([middle])]
    else:
        parts = [head.hashes[:whole_a]]
        if whole_a < na:
            parts.append(one.word_hashes([a.rsplit(None, 1)[-1]]))
    parts.append(tail.hashes[first_b : max(first_b, whole_b)])
    if whole_b < nb and nb > first_b:
        parts.append(one.word_hashes([b.rsplit(None, 1)[-1]]))
    return np.concatenate(parts)


def fingerprints(df: DataFrame, bins: int = 512, bits: int = 4, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches):
        one = OnePermutation(bins, bits, words)
        for b in _common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return _common.map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fingerprint string")


def with_next(df: DataFrame, fn, schema: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies fn to (row, next row) in descending order of id; the last row's next is the first.

    Rows are dealt to ranges of ids that follow from counts, each range is sorted within its task, and the first row of
    the range below comes along as a ghost, so that no task needs another's rows.  Ties of id are ordered by text.  A
    null id comes last.  fn gets an iterator of ((id, text), next text) and gives Arrow batches.
    """
    spark = df.sparkSession
    n = parts or _common.partitions_for(spark)
    least = -(1 << 63)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_k"), F.col(text_col).alias("text"))
    cuts = rows.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    # Range r holds the ids above cuts[r - 1] up to cuts[r].
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("_k"))) if cuts else F.lit(0)
    dealt = rows.withColumn("_r", part)
    tops = {r: k for r, k in dealt.groupBy("_r").agg(F.max("_k")).collect()}
    order = sorted(tops, reverse=True)
    if not order:
        return _common.map_batches(rows, lambda batches: (b for b in ()), schema)
    # The first row of the range below, and for the lowest range the first row of all: one row each.
    follows = {order[(i + 1) % len(order)]: r for i, r in enumerate(order)}
    heads = dealt.filter(F.col("_k").isin(list(set(tops.values())))).groupBy("_r", "_k").agg(F.min(F.struct(F.coalesce("text", F.lit("")), "doc_id")).alias("m"))
    heads = heads.filter(F.create_map(*[F.lit(x) for kv in tops.items() for x in kv])[F.col("_r")] == F.col("_k"))
    ghosts = heads.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("_k"), F.col("m").getField("col1").alias("text"), F.create_map(*[F.lit(x) for kv in follows.items() for x in kv])[F.col("_r")].alias("_r"), F.lit(1).alias("_ghost"))
    every = dealt.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    sorted_ = every.repartition(n, "_r").sortWithinPartitions(F.col("_r"), F.col("_ghost"), F.col("_k").desc(), F.coalesce("text", F.lit("")))

    def run(batches):
        def pairs():
            held = None
            for b in _common.slices(batches, "text"):
                for d, text, ghost in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if held is not None:
                        yield held, text
                    held = None if ghost else (d, text)

        yield from fn(pairs())

    return _common.map_batches(sorted_.select("doc_id", "text", "_ghost"), run, schema)


def edited(text: str | None, following: str | None) -> str:
    """The last half (rounded down) replaced by as many of the first code points of the next text."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit_report(df: DataFrame, bins: int = 512, bits: int = 4, words: int = 5, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike its fingerprint is to those of the edited and the next."""
    import hashlib

    def fn(pairs):
        one, rows = OnePermutation(bins, bits, words), []
        last_text, last = None, None

        def prepared(text: str) -> tuple[Hashed, bytes]:
            h = Hashed(one, text)
            return h, one.packed(one.values(one.combined(h.hashes)))

        for (d, text), following in pairs:
            text, following = text or "", following or ""
            mine, print_ = last if last is not None and last_text == text else prepared(text)
            theirs, their_print = prepared(following)
            half = len(text) // 2
            head, tail = text[: len(text) - half].encode(), following[:half].encode()
            edit = one.packed(one.values(one.combined(spliced(one, mine, len(head), theirs, len(tail)))))
            last_text, last = following, (theirs, their_print)
            rows.append((d, len(text), hashlib.sha256(head + tail).hexdigest(), print_.hex(), edit.hex(), one.likeness_of_bytes(print_, edit), one.likeness_of_bytes(print_, their_print)))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return with_next(df, fn, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", parts)
