"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: texts are lower-cased from A to Z and cut at ASCII white space; every run of `words` words, joined by
spaces, is hashed by XXH64; a bit is set where over half of the hashes set it.

Links: distinct fingerprints with at most `errors` differing bits.  The 64 bits are split into errors + 1 blocks, of which
at least one agrees between any two linked fingerprints.  For each block the fingerprints are dealt by its value, and each
bucket holds a binary trie over the other bits.  The trie is joined with itself: pairs of nodes are expanded together,
level by level, differing bits add up, and a pair is dropped once they exceed the budget.  A pair of subtrees whose
fingerprints are known to be connected is dropped as well, and the join runs with a budget of 0, 1, ... up to `errors`, so
that a cluster of thousands of near copies costs a spanning tree and not its square.  Buckets beyond `bucket` fingerprints
are split by further bits, and every pair of parts within the budget becomes a task of its own.

Components: the links of the tries (a spanning forest per bucket) are joined by alternating large-star and small-star
steps in Spark; exact copies share a fingerprint and enter by their least id.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; rows without an id take
part in components; a component without any id has a null component_id.  Repeated rows are kept; ids are cast to longs; an
empty table gives no rows; other columns may have any name and are handed through by keep_first().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common

_LOWER = bytes(range(256)).lower()
BITS = 64


def of_hashes(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes set it."""
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 200):
        counts += np.unpackbits(raw[k : k + 200], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    ws = (text or "").encode().translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    x = xxhash.xxh64_intdigest
    if len(ws) <= words:
        hashes = [x(joined, seed)]
    else:
        lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends + 1 - lengths).tolist()
        hashes = [x(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return of_hashes(np.array(hashes, np.uint64))


def fingerprints(df: DataFrame, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in _common.slices(batches, "text"):
            fp = np.array([simhash(x, words, seed) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return _common.map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


class _Forest:
    """Union-find over numbers, vectorised: roots by pointer jumping, links applied in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.parent = p
        return p

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the pairs; says which of them joined two trees."""
        parent = self.parent.tolist()
        used = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            while parent[j] != j:
                parent[j] = parent[parent[j]]
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                used[k] = True
        self.parent = np.array(parent)
        return used


class Trie:
    """Levels of a binary trie over sorted distinct keys: each node is a run of keys with a common prefix."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        n = len(keys)
        change = np.zeros(n, np.int64)
        if n > 1:
            # The first bit in which neighbours differ decides from which level on they are apart.
            d = keys[1:] ^ keys[:-1]
            top = np.zeros(n - 1, np.int64)
            for s in (32, 16, 8, 4, 2, 1):
                big = d >> np.uint64(s) > 0
                top += np.where(big, s, 0)
                d = np.where(big, d >> np.uint64(s), d)
            change[1:] = BITS - top
        self.change = change

    def level(self, depth: int) -> np.ndarray:
        """Starts of the runs of keys that share their first `depth` bits."""
        while len(self.starts) <= depth:
            apart = (self.change <= len(self.starts)) & (self.change > 0)
            apart[:1] = True
            self.starts.append(np.flatnonzero(apart))
        return self.starts[depth]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def join(keys: np.ndarray, errors: int, left: np.ndarray | None = None, depth: int = 0, most_pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of places in `keys` (sorted, distinct), of all links within the budget.

    The first `depth` bits of linked keys must agree: the join starts with the pairs of one node on that level.
    With `left`, a mask, only pairs of one key inside and one outside it are links."""
    n = len(keys)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    trie, forest = Trie(keys), _Forest(n)
    found_a, found_b = [], []
    side = None if left is None else left.astype(np.int64)
    for budget in range(1, errors + 1):
        roots = forest.roots()
        # Per key a running count lets a run of keys be tested for one root.
        changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])]) if n > 1 else np.zeros(1, np.int64)
        sides = None if side is None else np.concatenate([[0], np.cumsum(side)])
        nodes = np.arange(len(trie.level(depth)))
        stack = [(depth, nodes, nodes, np.zeros(len(nodes), np.int64))]
        while stack:
            at, a, b, err = stack.pop()
            if len(a) > most_pairs:
                for k in range(0, len(a), most_pairs // 2):
                    stack.append((at, a[k : k + most_pairs // 2], b[k : k + most_pairs // 2], err[k : k + most_pairs // 2]))
                continue
            here, below = trie.level(at), trie.level(at + 1)
            ends = np.append(below[1:], n)
            bound = np.append(here[1:], n)
            # Children of each node: the runs of the next level inside it, one or two; the bit tells which.
            first = np.searchsorted(below, here)
            two = np.searchsorted(below, bound) - first == 2
            bit = (keys[here] >> np.uint64(BITS - 1 - at) & np.uint64(1)).astype(np.int64)
            zero = np.where(two | (bit == 0), first, -1)
            one = np.where(two, first + 1, np.where(bit == 1, first, -1))
            same = a == b
            parts = []
            for x, y, more, keep in ((zero, zero, 0, None), (one, one, 0, None), (zero, one, 1, None), (one, zero, 1, ~same)):
                p, q = x[a], y[b]
                ok = (p >= 0) & (q >= 0) & (err + more <= budget)
                if keep is not None:
                    ok &= keep
                parts.append((p[ok], q[ok], err[ok] + more))
            a, b, err = (np.concatenate(x) for x in zip(*parts))
            if not len(a):
                continue
            sa, sb, ea, eb = below[a], below[b], ends[a], ends[b]
            alive = (changes[sa] != changes[ea - 1]) | (changes[sb] != changes[eb - 1]) | (roots[sa] != roots[sb])
            if sides is not None:
                la, lb = sides[ea] - sides[sa], sides[eb] - sides[sb]
                alive &= ((la > 0) & (lb < eb - sb)) | ((lb > 0) & (la < ea - sa))
            single = (ea - sa == 1) & (eb - sb == 1)
            leaf = alive & single & (sa != sb)
            if leaf.any():
                i, j = sa[leaf], sb[leaf]
                near = _popcount(keys[i] ^ keys[j]) <= budget
                i, j = i[near], j[near]
                used = forest.union(i, j)
                found_a.append(i[used])
                found_b.append(j[used])
                if used.any():
                    roots = forest.roots()
                    changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
            go = alive & ~single
            if go.any() and at + 1 < BITS:
                stack.append((at + 1, a[go], b[go], err[go]))
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _blocks(errors: int) -> list[tuple[int, int]]:
    """(shift, width) of errors + 1 blocks that make up the 64 bits."""
    n, out, at = errors + 1, [], 0
    for k in range(n):
        width = BITS // n + (k < BITS % n)
        out.append((at, width))
        at += width
    return out


def _u(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def links(prints: DataFrame, errors: int = 4, bucket: int = 200_000) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within `errors` bits that connect what all such pairs connect."""
    distinct = prints.select("fp").distinct()
    blocks = _blocks(errors)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for k, (s, w) in enumerate(blocks)])).alias("g")).select("fp", "g.k", "g.v")
    # Buckets beyond the bound: at most distinct / bucket of them per block, so their list is small.
    total = distinct.count()
    hot = {}
    if total > bucket:
        hot = {(r.k, r.v): r["count"] for r in keyed.groupBy("k", "v").count().filter(F.col("count") > bucket).collect()}

    def part_bits(k: int, count: int) -> list[int]:
        """Bits outside the block that a hot bucket is split by, spread over the word."""
        s, w = blocks[k]
        others = [x for x in range(BITS) if not s <= x < s + w]
        q = min(10, max(1, int(np.ceil(np.log2(count / bucket))) + 2))
        return others[:: len(others) // q][:q]

    plans = {key: part_bits(key[0], c) for key, c in hot.items()}

    def deal(batches):
        """Fingerprints of hot buckets go to every pair of parts within the budget that their part belongs to."""
        for b in batches:
            fp, k, v = (b.column(i).to_numpy() for i in range(3))
            out = [[], [], [], [], []]
            plain = np.ones(len(fp), bool)
            for (hk, hv), bits in plans.items():
                mine = (k == hk) & (v == hv)
                if not mine.any():
                    continue
                plain &= ~mine
                u = _u(fp[mine])
                part = np.zeros(len(u), np.int64)
                for i, x in enumerate(bits):
                    part |= (u >> np.uint64(x) & np.uint64(1)).astype(np.int64) << i
                for d in range(errors + 1):
                    for flips in combinations(range(len(bits)), d):
                        other = part ^ sum(1 << i for i in flips)
                        for col, value in zip(out, (fp[mine], np.full(len(u), hk), np.full(len(u), hv), np.minimum(part, other), np.maximum(part, other))):
                            col.append(value)
            for col, value in zip(out, (fp[plain], k[plain], v[plain], np.full(plain.sum(), -1), np.full(plain.sum(), -1))):
                col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, (np.int64, np.int32, np.int64, np.int64, np.int64))], names=["fp", "k", "v", "p", "q"])

    dealt = _common.map_batches(keyed.select("fp", "k", "v"), deal, "fp long, k int, v long, p long, q long") if plans else keyed.select("fp", "k", "v", F.lit(-1).cast("long").alias("p"), F.lit(-1).cast("long").alias("q"))

    def group_links(fp: np.ndarray, k: int, v: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        s, w = blocks[k]
        # The agreeing block goes first: all buckets of a block in this task are joined in one trie, from its level on.
        u = np.unique(_u(fp))
        turn = (s + w) % BITS
        keys = u >> np.uint64(turn) | u << np.uint64(BITS - turn) if turn else u
        order = np.argsort(keys)
        keys = keys[order]
        left = None
        if p != q:
            part = np.zeros(len(keys), np.int64)
            for i, x in enumerate(plans[k, v]):
                part |= (u[order] >> np.uint64(x) & np.uint64(1)).astype(np.int64) << i
            left = part == p
        a, b = join(keys, errors, left, w)
        return u[order[a]].view(np.int64), u[order[b]].view(np.int64)

    def run(batches):
        """Rows come in order of their group; a group ends where its key changes."""
        held, key = [], None

        def done():
            fp = np.concatenate(held)
            a, b = group_links(fp, *key) if len(fp) > 1 else (fp[:0], fp[:0])
            return a, b

        out_a, out_b, size = [], [], 0
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            if not len(cols[0]):
                continue
            cols[2] = np.where(cols[3] < 0, -1, cols[2])
            ids = np.stack(cols[1:], axis=1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for x, y in zip(edges[:-1], edges[1:]):
                now = tuple(ids[x].tolist())
                if key is not None and now != key:
                    a, c = done()
                    out_a.append(a)
                    out_b.append(c)
                    size += len(a)
                    held = []
                key = now
                held.append(cols[0][x:y])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b, size = [], [], 0
        if key is not None:
            a, c = done()
            out_a.append(a)
            out_b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    n = _common.partitions_for(prints.sparkSession)
    return _common.map_batches(dealt.repartition(n, "k", "v", "p", "q").sortWithinPartitions("k", "p", "q", "v"), run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the least node of its component.

    Large-star and small-star steps alternate until the edges stop changing; each round is a table in the shared folder.
    A node with many neighbours is aggregated by least neighbour (partial sums first), never gathered in one task."""
    now = _common.cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # Large star: every neighbour above a node is linked to the node's least neighbour.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's neighbours below it, and itself, are linked to the least of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()
        after = _common.cut(small, "star")
        n, total = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        _common.discard(now)
        now = after
        if (n, total) == last:
            break
        last = (n, total)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, words: int = 4, errors: int = 4, seed: int = 42, bucket: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (least id of all that links lead to) of every row."""
    prints = _common.cut(fingerprints(df, words, seed, id_col, text_col), "simhash")
    roots = components(links(prints, errors, bucket))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = grouped.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(class_of, prints["fp"] == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 4, errors: int = 4) -> DataFrame:
    """One document of each component stays: the one with the least id; of repeated rows with that id, one."""
    rows = _common.cut(docs.select(F.monotonically_increasing_id().alias("_row"), _common.packed(docs)), "rows")
    prints = _common.cut(fingerprints(rows.select(F.col("_row").alias("doc_id"), F.col("doc.text").alias("text")), words), "simhash")
    order = rows.select("_row", F.struct(F.col("doc.doc_id").isNull().alias("n"), F.col("doc.doc_id").cast("long").alias("d"), F.col("_row").alias("r")).alias("o"))
    roots = components(links(prints, errors))
    of = prints.join(roots, prints["fp"] == roots["node"], "left").select(F.col("doc_id").alias("_row"), F.coalesce("root", "fp").alias("root"))
    first = of.join(order, "_row").groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.r").alias("_row"))
    return rows.join(first, "_row", "left_semi").select("doc.*")
