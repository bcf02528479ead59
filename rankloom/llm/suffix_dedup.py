"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else in the table.  Sorting every suffix
of a corpus would shuffle each byte hundreds of times, so the sort is sparse:

* Anchors.  Of every `length` bytes, the leftmost k-gram of least hash is an anchor; equal strings have equal anchors at
  equal places.  Rows of (anchor hash, digest of the context of all strings around the anchor, text, place) are dealt by
  anchor hash and sorted.  Anchors that occur once hold no repeat; contexts that occur twice are repeats as a whole.  Such
  contexts are told by a cryptographic digest of 128 bits, which has nothing in common with the hashes that chose the anchor.
* Suffix sort.  Where one anchor has different contexts, these are gathered and the suffixes from the anchor on are
  sorted by mergesort.  Two suffixes are compared by their common extension, found by binary search over prefix
  polynomial hashes, in logarithmic time.  Neighbours' common extensions give, for each length to the right, intervals
  of suffixes that agree; suffixes of an interval with equal hashes to the left share a string.  Each pair so found is
  verified byte by byte; a collision sends the batch to an exact comparison.
* Anchors with more than `most` different contexts aren't gathered.  Their strings are split by place in rounds: a range
  of places has its own common part and its own context, both only as digests, which Spark counts with partial sums; a
  range whose contexts still differ is split in four again, down to single strings.  What counts as a repeat here agrees
  in a digest of 128 bits.

Texts are identified by id and a hash of the text.  Defined results: null and empty texts keep nothing and lose nothing;
texts shorter than `length` keep all; repeated rows repeat each other's strings; null ids are allowed; ids are cast to longs.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import _common

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(n, b, _U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Hashes:
    """Prefix polynomial hashes modulo 2^64 of a buffer, over random odd values of bytes."""

    def __init__(self, buf: np.ndarray):
        self.buf, n = buf, len(buf)
        pw, self.inv = _powers(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[buf] * pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the strings at start of the given sizes."""
        return (self.sums[start + size] - self.sums[start]) * self.inv[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, limit: int) -> np.ndarray:
        """Lengths of the common extensions to the right, at most `most` each, which is at most `limit`."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        for _ in range(int(limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(mid - 1, low))
        return low


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, anchor hash, digest of the context as two numbers) of every anchor of the texts."""
    long = [i for i, x in enumerate(texts) if len(x) >= length]
    if not long:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty((0, 2), np.int64)
    sizes = np.array([len(texts[i]) for i in long], np.int64)
    data = b"".join([texts[i] for i in long])
    buf = np.frombuffer(data, np.uint8)
    n, w = len(buf), length - k + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    hashes = Hashes(buf)
    m = n - k + 1
    grams = (hashes.sums[k:] - hashes.sums[:m]) * hashes.inv[:m]
    owner = np.repeat(np.arange(len(long)), sizes)
    # Forty bits of hash and the place in a block of w: a block's least is its leftmost of the least hashes.
    order = (_mix(grams) & _U(0xFFFFFFFFFF000000)) | (np.arange(m) % w).astype(_U)
    # Least of every w neighbours: running minima from both ends of the blocks that they touch; of equals the left one.
    pad = -m % w
    blocks = np.concatenate([order, np.full(pad, ~_U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 : m]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[: m - w + 1]
    i = np.arange(m - w + 1)
    left = back >> _U(24) <= ahead >> _U(24)
    place = np.where(left, i // w * w + (back & _U(0xFFFFFF)).astype(np.int64), (i + w - 1) // w * w + (ahead & _U(0xFFFFFF)).astype(np.int64))
    own = owner[: m - w + 1]
    inside = i + length <= ends[own]
    place, own = place[inside], own[inside]
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    place, own = place[keep], own[keep]
    reach = length - k
    a, b = np.maximum(place - reach, starts[own]), np.minimum(place + length, ends[own])
    digest = hashlib.blake2b
    found = b"".join([digest(data[x:y] + z, digest_size=16).digest() for x, y, z in zip(a.tolist(), b.tolist(), (place - a).astype("<u4").view("V4").tolist())])
    return np.array(long)[own], place - starts[own], _mix(grams[place] + _U(1)), np.frombuffer(found, "<i8").reshape(-1, 2)


def merge_sort(hashes: Hashes, at: np.ndarray, size: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """The order of suffixes within their groups (numbers that do not fall), bottom up, all runs of a level at once."""
    n = len(at)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[first, n])
    base, count = np.repeat(first, counts), np.repeat(counts, counts)
    order, run = np.arange(n), 1

    def less(x: np.ndarray, y: np.ndarray, or_same: np.ndarray) -> np.ndarray:
        most = np.minimum(size[x], size[y])
        c = hashes.common(at[x], at[y], most, limit)
        over = c >= most
        p, q = hashes.buf[at[x] + np.where(over, 0, c)], hashes.buf[at[y] + np.where(over, 0, c)]
        return np.where(over, (size[x] < size[y]) | (or_same & (size[x] == size[y])), p < q)

    while (counts > run).any():
        pos = np.flatnonzero(count > run)
        i = pos - base[pos]
        r = i // run
        start = (r ^ 1) * run
        stop = np.minimum(start + run, count[pos])
        here = start < count[pos]
        pos, i, r, start, stop = pos[here], i[here], r[here], start[here], stop[here]
        low, high = start.copy(), stop.copy()
        mine = order[pos]
        # Elements of a right run count equal ones of the left run as before them, so the sort is stable.
        right = (r & 1).astype(bool)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) >> 1
            other = order[base[pos[todo]] + mid]
            before = less(other, mine[todo], right[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        target = base[pos] + (r & ~1) * run + (i - r * run) + (low - start)
        after = order.copy()
        after[target] = mine
        order, run = after, run * 2
    return order


def shared_strings(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each context, the strings (by bytes left of the anchor, 0 to length - k) that another context of its group has."""
    n, reach = len(contexts), length - k
    found = np.zeros((n, reach + 1), bool)
    if n < 2:
        return found
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    start = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    hashes = Hashes(buf)
    at, size = start + left, sizes - left
    order = merge_sort(hashes, at, size, group, length)
    a, ls, rs, g = at[order], left[order], size[order], group[order]
    near = np.zeros(n, np.int64)
    near[1:] = np.where(g[1:] == g[:-1], hashes.common(a[:-1], a[1:], np.minimum(rs[:-1], rs[1:]), length), -1)
    near[0] = -1
    pairs = []
    for l in range(reach + 1):
        need = length - l
        ok = np.flatnonzero((rs >= need) & (ls >= l))
        if len(ok) < 2:
            continue
        interval = np.cumsum(near < need)[ok]
        key = _mix(interval.astype(_U) * _U(_BASE) + _mix(hashes.of(a[ok] - l, l) + _U(7)))
        by = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        if len(same):
            x, y = ok[by[same]], ok[by[same + 1]]
            found[x, l] = found[y, l] = True
            pairs.append(np.stack([x, y, np.full(len(x), l)]))
    if not pairs:
        return found
    # Verification: each pair once, with its farthest places, byte by byte around the anchor.
    x, y, l = np.concatenate(pairs, axis=1)
    code = x * n + y
    by = np.argsort(code, kind="stable")
    cut = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]])
    most, least = np.maximum.reduceat(l[by], cut), np.minimum.reduceat(l[by], cut)
    x, y = x[by][cut], y[by][cut]
    for c in range(0, len(x), 4096):
        s = slice(c, c + 4096)
        offsets = np.arange(-reach, length)
        inside = (offsets >= -most[s, None]) & (offsets < length - least[s, None])
        p = np.clip(a[x[s], None] + offsets, 0, len(buf) - 1)
        q = np.clip(a[y[s], None] + offsets, 0, len(buf) - 1)
        if ((buf[p] != buf[q]) & inside).any():
            return _exact(contexts, left, group, length, k)
    out = np.zeros_like(found)
    out[order] = found
    return out


def _exact(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int, k: int) -> np.ndarray:
    """The same by comparing strings themselves."""
    found = np.zeros((len(contexts), length - k + 1), bool)
    seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for c, text in enumerate(contexts):
        for l in range(length - k + 1):
            s = int(left[c]) - l
            if s >= 0 and s + length <= len(text):
                seen.setdefault((int(group[c]), text[s : s + length]), []).append((c, l))
    for places in seen.values():
        if len(places) > 1:
            for c, l in places:
                found[c, l] = True
    return found


def _spans(flags: np.ndarray, length: int) -> list[dict[str, int]]:
    """Bytes relative to the anchor that the flagged strings cover."""
    ls = np.flatnonzero(flags)
    if not len(ls):
        return []
    cuts = np.flatnonzero(np.diff(ls) > 1)
    first, last = ls[np.r_[0, cuts + 1]], ls[np.r_[cuts, len(ls) - 1]]
    return [{"s": -int(q), "e": length - int(p)} for p, q in zip(first, last)]


_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_SPAN_SQL = "array<struct<s:int,e:int>>"
_FOUND = "_did long, _rk int, pos int, spans array<struct<s:int,e:int>>"


def covers(df: DataFrame, length: int = 200, k: int = 64, most: int = 300) -> DataFrame:
    """(_did, _rk, spans): the bytes of each text that repeated strings cover, merged.

    df has _did, _rk and text, see keyed()."""
    spark, reach = df.sparkSession, length - k
    n = _common.partitions_for(spark)

    def emit(batches):
        for b in _common.slices(batches, "text", 1 << 20):
            did, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            own, place, ah, c = anchors([(x or "").encode() for x in b.column(2).to_pylist()], length, k)
            yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(did[own]), pa.array(rk[own]), pa.array(place.astype(np.int32))], names=["ah", "c0", "c1", "_did", "_rk", "pos"])

    rows = _common.map_batches(df.select("_did", "_rk", "text"), emit, "ah long, c0 long, c1 long, _did long, _rk int, pos int").repartition(n, "ah")
    # One order of an anchor's rows tells which contexts occur again, and how many there are.
    anchor = Window.partitionBy("ah")
    by = anchor.orderBy("c0", "c1")
    beside = lambda f: F.coalesce((f("c0").over(by) == F.col("c0")) & (f("c1").over(by) == F.col("c1")), F.lit(False))
    told = rows.select("*", beside(F.lag).alias("again"), beside(F.lead).alias("_next")).select("ah", "_did", "_rk", "pos", "again", (F.col("again") | F.col("_next")).alias("whole"))
    counted = told.select("*", F.count("*").over(anchor).alias("n"), F.sum((~F.col("again")).cast("int")).over(anchor).alias("kinds")).filter("n > 1")
    members = _common.cut(counted.select("ah", "_did", "_rk", "pos", "whole", (~F.col("again") & (F.col("kinds") > 1)).alias("asked"), (F.col("kinds") > most).alias("wide")), "members")
    del rows, told, counted
    _common.release(spark)
    # The texts around anchors with different contexts, one of each kind, are read from the documents.
    wanted = members.filter("asked").groupBy("_did", "_rk").agg(F.collect_list(F.struct("ah", "pos", "whole", "wide")).alias("at"))
    # A table of known size: Spark sends it to the texts as long as its limit allows, and deals both beyond that.
    wanted = _common.cut(wanted, "wanted")

    def fetch(batches):
        for b in _common.slices(batches, "text", 2 << 20):
            out = [[], [], [], [], [], [], [], []]
            for did, rk, text, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                for x in at:
                    p = x["pos"]
                    a = max(0, p - reach)
                    for col, v in zip(out, (did, rk, p, x["ah"], x["whole"], x["wide"], p - a, data[a : p + length])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()))], names=["_did", "_rk", "pos", "ah", "whole", "wide", "lft", "ctx"])

    # Rows that repeat id and text give their contexts once.
    fetched = _common.map_batches(df.select("_did", "_rk", "text").join(wanted, ["_did", "_rk"]).select("_did", "_rk", "text", "at"), fetch, "_did long, _rk int, pos int, ah long, whole boolean, wide boolean, lft int, ctx binary")
    texts = _common.cut(fetched, "texts")
    del fetched
    _common.release(spark)

    def sort_groups(batches):
        """Rows come in order of anchor; whole groups are sorted in batches."""

        def work(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held)
            ah, did, rk, pos, lft, whole = (t.column(c).to_numpy() for c in ("ah", "_did", "_rk", "pos", "lft", "whole"))
            # A row that stands twice in the table gives its context twice; it is a repeat as a whole already.
            once = np.ones(len(ah), bool)
            once[1:] = (ah[1:] != ah[:-1]) | (did[1:] != did[:-1]) | (rk[1:] != rk[:-1]) | (pos[1:] != pos[:-1])
            ah, did, rk, pos, lft, whole = (x[once] for x in (ah, did, rk, pos, lft.astype(np.int64), whole))
            ctx = t.column("ctx").filter(pa.array(once)).to_pylist()
            flags = shared_strings(ctx, lft, np.cumsum(np.r_[0, ah[1:] != ah[:-1]]), length, k)
            # A context that is no repeat as a whole occurs once, at the place that it came from.
            hit = np.flatnonzero(flags.any(axis=1) & ~whole)
            return pa.RecordBatch.from_arrays([pa.array(did[hit]), pa.array(rk[hit]), pa.array(pos[hit]), pa.array([_spans(flags[i], length) for i in hit], _SPAN)], names=["_did", "_rk", "pos", "spans"])

        held, count = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if count + len(t) > 6000:
                # The last group may go on in the next batch.
                every = pa.concat_tables([*held, t])
                ah = every.column("ah").to_numpy()
                edge = int(np.searchsorted(ah, ah[-1])) if len(ah) else 0
                if edge:
                    yield work([every.slice(0, edge)])
                    every = every.slice(edge)
                held, count = [every], len(every)
            else:
                held.append(t)
                count += len(t)
        if count:
            yield work(held)

    narrow = texts.filter("NOT wide").select("ah", "_did", "_rk", "pos", "whole", "lft", "ctx").repartition(n, "ah").sortWithinPartitions("ah", "_did", "_rk", "pos")
    found = _common.map_batches(narrow, sort_groups, _FOUND)
    tables = [members, texts, wanted]
    wide = texts.filter("wide")
    if wide.limit(1).count():
        more, made = _split(wide.select("ah", "_did", "_rk", "pos", "whole", "lft", "ctx"), length, k)
        found, tables = found.unionByName(more), tables + made
    # Spans that are null are all strings around the anchor.
    whole = members.filter("whole").select("_did", "_rk", "pos", F.lit(None).cast(_SPAN_SQL).alias("spans"))
    placed = whole.unionByName(found).groupBy("_did", "_rk").agg(F.collect_list(F.struct("pos", "spans")).alias("at"))
    everything = [{"s": -reach, "e": length}]

    def merge(batches):
        for b in batches:
            out = []
            for at in b.column(2).to_pylist():
                merged: list[list[int]] = []
                for s, e in sorted((max(0, x["pos"] + y["s"]), x["pos"] + y["e"]) for x in at for y in (everything if x["spans"] is None else x["spans"])):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                out.append([{"s": s, "e": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _SPAN)], names=["_did", "_rk", "spans"])

    done = _common.cut(_common.map_batches(placed, merge, f"_did long, _rk int, spans {_SPAN_SQL}"), "covers")
    for x in tables:
        _common.discard(x)
    return done


def _split(texts: DataFrame, length: int, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """Shared strings of anchors with many contexts: ranges of places are split in four until their contexts agree or are
    alone.  Also the tables that this reads."""
    reach = length - k
    # The whole range is known to differ, so the first round starts with its quarters.
    step = -(-(reach + 1) // 4)
    first = [(s, min(s + step - 1, reach)) for s in range(0, reach + 1, step)]
    own = ["_did", "_rk", "pos", "whole", "ah", "lft", "ctx"]
    todo = texts.select(F.monotonically_increasing_id().alias("r"), *own, F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in first]).alias("ranges"))
    todo = _common.cut(todo, "ranges")
    results, made = [], [todo]
    while True:

        def hashes(batches):
            for b in batches:
                r, ah, lft, ctx, ranges = (b.column(i).to_pylist() for i in range(5))
                out = [[], [], [], [], [], []]
                for i in range(len(r)):
                    text, at = ctx[i], lft[i]
                    for x in ranges[i]:
                        # Strings with p to q bytes left of the anchor, as far as the text reaches.
                        p, q = max(x["s"], length - (len(text) - at)), min(x["e"], at)
                        if p > q:
                            continue
                        kernel = hashlib.blake2b(ah[i].to_bytes(8, "little", signed=True) + text[max(0, at - x["s"]) : at + length - x["e"]], digest_size=8).digest()
                        all_ = hashlib.blake2b(struct.pack("<II", p, q) + text[at - q : at + length - p], digest_size=16).digest()
                        for col, v in zip(out, (r[i], x["s"], x["e"], *struct.unpack("<q", kernel), *struct.unpack("<qq", all_))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["r", "s", "e", "kernel", "d0", "d1"])

        marks = _common.cut(_common.map_batches(todo.select("r", "ah", "lft", "ctx", "ranges"), hashes, "r long, s int, e int, kernel long, d0 long, d1 long"), "marks")
        same = ["kernel", "s", "e", "d0", "d1"]
        counts = marks.groupBy(*same).agg(F.count("*").alias("n"), F.min("r").alias("first"))
        kernels = counts.groupBy("kernel", "s", "e").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        # Of contexts that agree one goes on, for those that agree with it in a part of the range only.
        judged = _common.cut(marks.join(counts, same).join(kernels, ["kernel", "s", "e"]).filter("total > 1").select("r", "s", "e", (F.col("n") > 1).alias("hit"), ((F.col("r") == F.col("first")) & (F.col("kinds") > 1) & (F.col("e") > F.col("s"))).alias("go")), "judged")
        _common.discard(marks)
        step = F.ceil((F.col("e") - F.col("s") + 1) / F.lit(4)).cast("int")
        quarters = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct((F.col("s") + i * step).alias("s"), F.least(F.col("s") + (i + 1) * step - 1, F.col("e")).alias("e")))
        per_row = judged.groupBy("r").agg(F.collect_list(F.when(F.col("hit"), F.struct("s", "e"))).alias("hits"), F.flatten(F.collect_list(F.when(F.col("go"), F.filter(quarters, lambda x: x["s"] <= x["e"])))).alias("rest"))
        after = _common.cut(todo.drop("ranges").join(per_row, "r"), "ranges")
        _common.discard(judged)
        made.append(after)
        results.append(after.filter((F.size("hits") > 0) & ~F.col("whole")).select("_did", "_rk", "pos", "lft", F.octet_length("ctx").alias("n"), "hits"))
        todo = after.filter(F.size("rest") > 0).select("r", *own, F.col("rest").alias("ranges"))
        if not todo.limit(1).count():
            break
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    # Strings with p to q bytes left of the anchor cover from -q to length - p.
    spans = F.transform("hits", lambda x: F.struct((-F.least(x["e"], F.col("lft"))).alias("s"), (F.lit(length) - F.greatest(x["s"], F.lit(length) - (F.col("n") - F.col("lft")))).cast("int").alias("e")))
    return out.select("_did", "_rk", "pos", spans.alias("spans")), made


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_did and _rk, which tell texts apart (the id, a hash of the text where it is null, and a hash of the text), the text,
    and all columns as one struct `doc`."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    did = F.coalesce(F.col(id_col).cast("long"), -F.abs(h.bitwiseAND(F.lit((1 << 62) - 1))) - 1)
    return docs.select(did.alias("_did"), h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_rk"), F.col(text_col).alias("text"), _common.packed(docs))


def _kept(data: bytes, spans: list[dict[str, int]] | None) -> tuple[bytes, int, int]:
    if not spans:
        return data, 0, 0
    parts, at, gone = [], 0, 0
    for x in spans:
        s, e = x["s"], min(x["e"], len(data))
        parts.append(data[at:s])
        gone += e - s
        at = e
    parts.append(data[at:])
    return b"".join(parts), gone, len(spans)


def report(docs: DataFrame, length: int = 200, k: int = 64, most: int = 300) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    df = keyed(docs.select("doc_id", "text"))
    found = covers(df, length, k, most)

    def run(batches):
        for b in _common.slices(batches, "text"):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (text or "").encode()
                kept, gone, count = _kept(data, spans)
                rows.append((len(data), gone, count, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _common.map_batches(df.join(found, ["_did", "_rk"], "left").select(F.col("doc.doc_id").cast("long").alias("doc_id"), "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, length: int = 200, k: int = 64, most: int = 300) -> DataFrame:
    """The documents without their repeated strings, with the columns they came with; n_chars follows the text.

    What a cut leaves of a character's bytes is dropped.  Documents stay, if only with an empty text.  Other columns may
    have any name."""
    names = docs.columns
    df = keyed(docs)
    found = covers(df.select("_did", "_rk", "text"), length, k, most)
    joined = df.join(found, ["_did", "_rk"], "left").select("doc.*", F.col("spans").alias(_common.fresh("spans", names)))
    schema = docs.schema

    def run(batches):
        for b in _common.slices(batches, "text"):
            at = b.schema.get_field_index("text")
            texts = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                texts.append(text if text is None or not spans else _kept(text.encode(), spans)[0].decode("utf-8", "ignore"))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                c = names.index("n_chars")
                cols[c] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _common.map_batches(joined, run, schema)
