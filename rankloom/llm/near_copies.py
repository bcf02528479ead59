"""Near copies by similarity of shingles: links of the SimHash trie join, then of MinHash bands, each confirmed exactly.

Shingles: texts are lower-cased from A to Z and cut at ASCII white space; every run of `words` words, joined by spaces, is
hashed by XXH64; a text of no more words than that is one shingle.  Two texts are linked if the Jaccard similarity of their
sets of shingle hashes is `least` or more.  Texts with equal sets are one.  Components are those of op1 (`simhash.components`).

The SimHash trie join comes first: a set's fingerprint has a bit set where over half of its hashes set it; `simhash.links`
joins the tries of all fingerprints within `errors` bits, and sets of one fingerprint are linked to the least of them.  A link
counts if the similarity of its ends is `least` or more.

That budget can't reach all pairs: at 0.8 they lie about ten of 64 bits apart.  The rest is found between the components that
the tries leave.  BANDS keys of ROWS least hashes each are made of a set; a pair of similarity 0.8 agrees in none of them with
a chance of 3 in a million, a more similar one more seldom.  A bucket is what agrees in a key.

* Every set is compared with the least of each bucket that it is in, unless they are connected.  Here and in the links of the
  tries, pairs that agree in fewer than AGREE of the least hashes (six standard deviations below what 0.8 gives) are not
  compared by their texts.
* Buckets that this leaves in several components go on.  Where the largest component has over `block` members, the others
  are compared with LEADERS of it.
* In the buckets that are still in several components, all others are compared with the largest one and with each other, in
  blocks: a task holds the sets of two blocks, counts the shingles that each two have in common by one product of matrices,
  and gives links only.  No pair is a row.

So a cluster of thousands of near copies costs a few comparisons each; only a bucket of texts that all fall short of `least`
costs its square, about a microsecond a pair.

Defined results: null, empty and blank texts have one and the same empty shingle; rows without an id come last; components
are those of the links, so their ends can be less similar than `least`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common, simhash

BANDS, ROWS, LEADERS, AGREE, BLOCK = 32, 5, 8, 97, 256
_LOWER = bytes(range(256)).lower()
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    ws = (text or "").encode().translate(_LOWER).split()
    joined = b" ".join(ws)
    x = xxhash.xxh64_intdigest
    if len(ws) <= words:
        return np.array([x(joined)], np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths).tolist()
    return np.unique(np.array([x(joined[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64))


def sketch(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of the bands, and a byte of every least hash."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 1024):
        np.minimum(least, (_FACTORS[:, None] * found[None, k : k + 1024]).min(axis=1), out=least)
    mixed = (least ^ least >> np.uint64(29)).reshape(BANDS, ROWS) * _MIX
    return (mixed ^ mixed >> np.uint64(32)).sum(axis=1, dtype=np.uint64).view(np.int64), (least >> np.uint64(16)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """_row, digest of the set (two numbers), its size, its fingerprint, its keys and a byte of every least hash."""

    def run(batches):
        for b in _common.slices(batches, "text"):
            hi, lo, size, fp, keys, signs = [], [], [], [], [], []
            for x in b.column(1).to_pylist():
                found = shingles(x, words)
                d = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                size.append(len(found))
                fp.append(simhash.of_hashes(found))
                k, sign = sketch(found)
                keys.append(k)
                signs.append(sign)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            columns = [b.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(size, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "hi", "lo", "size", "fp", "keys", "sign"])

    return _common.map_batches(rows.select("_row", "text"), run, "_row long, hi long, lo long, size int, fp long, keys array<long>, sign binary")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of the pairs of rows (a, b) that agree in enough least hashes."""

    def run(batches):
        for b in _common.slices(batches, "x"):
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, BANDS * ROWS) for c in b.columns[2:])
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    for end, sign in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sketches.select(F.col("_row").alias(end), F.col("sign").alias(sign)), end)
    return _common.map_batches(pairs.select("a", "b", "x", "y"), run, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs of rows (a, b) that are similar enough."""

    def run(batches):
        last, right = None, None
        for b in _common.slices(batches, "ta"):
            out_a, out_b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if j != last:
                    last, right = j, shingles(y, words)
                if similarity(shingles(x, words), right) >= least:
                    out_a.append(i)
                    out_b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    # The texts lie in buckets by row, so only the pairs are dealt to them; then texts at the end a go to those at the end b.
    left = pairs.join(rows.select(F.col("_row").alias("a"), F.col("text").alias("ta")), "a")
    asked = rows.select(F.col("_row").alias("b"), F.col("text").alias("tb")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = left.join(asked, "b")
    return _common.map_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def close_pairs(sets: list[np.ndarray], classes: np.ndarray, least: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of places, of the links between sets of different classes."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    # Only what two sets hold can be common.
    shared = np.bincount(number)[number] > 1
    number, owner = np.unique(number[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((m, m), np.float32)
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, (k, k + width))
        held = np.zeros((m, min(width, int(number[-1]) + 1 - k)), np.float32)
        held[owner[a:b], number[a:b] - k] = 1
        both += held @ held.T
    common = both.astype(float)
    near = common / (sizes[:, None] + sizes[None, :] - common) >= least
    i, j = np.nonzero(np.triu(near & (classes[:, None] != classes[None, :]), 1))
    used = simhash._Forest(m).union(i, j)
    return i[used], j[used]


def _in_blocks(placed: DataFrame, texts: DataFrame, words: int, least: float, block: int) -> DataFrame:
    """Links (a, b) of all pairs of different components in the buckets; placed has key, r, c, main, n_main and total."""
    others, mains = F.ceil((F.col("total") - F.col("n_main")) / F.lit(block)).cast("int"), F.ceil(F.col("n_main") / F.lit(block)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("r"), n).cast("int")

    def task(i, j):
        return F.struct("key", i.cast("int").alias("i"), j.cast("int").alias("j"), "c")

    # Blocks of others have numbers from 0 on, those of the largest component negative ones.
    with_others = F.transform(F.sequence(F.lit(0), others - 1), lambda x: task(F.least(mine(others), x), F.greatest(mine(others), x)))
    with_main = F.transform(F.sequence(F.lit(1), mains), lambda x: task(mine(others), -x))
    of_main = F.transform(F.sequence(F.lit(0), others - 1), lambda x: task(x, -1 - mine(mains)))
    whole = F.array(task(F.lit(0), F.lit(0)))
    tasks = F.when(F.col("total") <= 2 * block, whole).when(F.col("c") != F.col("main"), F.concat(with_others, with_main)).otherwise(of_main)
    asked = placed.select("r", tasks.alias("t")).groupBy("r").agg(F.flatten(F.collect_list("t")).alias("t"))
    asked = _common.cut(asked, "asked")

    def deal(batches):
        for b in _common.slices(batches, "text", 1 << 18):
            out = [[], [], [], [], [], []]
            for r, text, tasks in zip(*(c.to_pylist() for c in b.columns)):
                found = shingles(text, words).tobytes()
                for t in tasks:
                    for col, v in zip(out, (t["key"], t["i"], t["j"], t["c"], r, found)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["key", "i", "j", "c", "r", "found"])

    def compare(batches):
        """Rows come in order of their task."""
        held, key = [], None

        def done() -> pa.RecordBatch:
            classes, r = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            a, b = close_pairs([np.frombuffer(x[2], np.uint64) for x in held], classes, least)
            return pa.RecordBatch.from_arrays([pa.array(r[a]), pa.array(r[b])], names=["a", "b"])

        for b in batches:
            for k, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if key != (k, i, j):
                    if len(held) > 1:
                        yield done()
                    held, key = [], (k, i, j)
                held.append(row)
        if len(held) > 1:
            yield done()

    n = _common.partitions_for(placed.sparkSession)
    dealt = _common.map_batches(texts.join(asked, texts["_row"] == asked["r"]).select("r", "text", "t"), deal, "key long, i int, j int, c long, r long, found binary")
    return _common.map_batches(dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j"), compare, "a long, b long")


def _trie_pairs(sets: DataFrame, errors: int) -> DataFrame:
    """Pairs of rows (a, b), a > b: the links of the trie join of their fingerprints, and rows with the least of theirs."""
    of_print = sets.groupBy("fp").agg(F.min("r").alias("m"))
    near = simhash.links(of_print, errors)
    for end in "ab":
        near = near.join(of_print.select(F.col("fp").alias(end), F.col("m").alias(f"_{end}")), end)
    equal = sets.join(of_print, "fp").filter("r > m").select(F.col("r").alias("a"), F.col("m").alias("b"))
    return equal.unionByName(near.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")))


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8, block: int = BLOCK, errors: int = 4) -> DataFrame:
    """One document of each component stays: the one with the least id; of repeated rows with that id, one."""
    # Dealt once, by row: at every size the joins with texts below move narrow tables of rows, and no text again.
    rows = _common.cut_by(docs.select(F.monotonically_increasing_id().alias("_row"), _common.packed(docs)), "rows", "_row")
    texts = rows.select("_row", F.col("doc.text").alias("text"))
    sketches = _common.cut(_sketches(texts, words), "sketches")
    order = F.struct(F.col("doc.doc_id").isNull().alias("n"), F.col("doc.doc_id").cast("long").alias("d"), F.col("_row").alias("r"))
    ordered = rows.select("_row", order.alias("o")).join(sketches.select("_row", "hi", "lo", "fp"), "_row")
    sets = _common.cut(ordered.groupBy("hi", "lo").agg(F.min("o").alias("o"), F.min("fp").alias("fp")).select("o", F.col("o.r").alias("r"), "fp"), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of rows (a, b) that are links."""
        some = _common.cut(pairs, "pairs")
        likely = _common.cut(_likely(some, sketches), "likely")
        _common.discard(some)
        found = _common.cut(_confirmed(likely, texts, words, least), "links")
        _common.discard(likely)
        return found

    links = checked(_trie_pairs(sets, errors))
    of = simhash.components(links)

    keyed = sketches.join(sets.select(F.col("r").alias("_row")), "_row", "left_semi").select(F.explode("keys").alias("key"), F.col("_row").alias("r"), "size")
    shared = keyed.groupBy("key").agg(F.min("r").alias("m"), F.max("r").alias("x")).filter("m < x").select("key")
    placed = keyed.join(shared, "key").join(of, keyed["r"] == of["node"], "left")
    placed = _common.cut(placed.select("key", "r", "size", F.coalesce("root", "r").alias("c")), "placed")

    def linked(one: DataFrame, leaders: DataFrame) -> DataFrame:
        """Links of (key, a) and (key, b), where a and b have r, size and c."""
        close = F.least("a.size", "b.size") >= F.lit(least) * F.greatest("a.size", "b.size")
        return checked(one.join(leaders, "key").filter((F.col("a.c") != F.col("b.c")) & close).select(F.greatest("a.r", "b.r").alias("a"), F.least("a.r", "b.r").alias("b")).distinct())

    def still_split(of: DataFrame, before: DataFrame) -> DataFrame:
        """Members of the buckets in several components, with their component and the bucket's largest."""
        now = before.select("key", "r", "size").join(of, before["r"] == of["node"], "left").select("key", "r", "size", F.coalesce("root", "r").alias("c"))
        sums = now.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("total"))
        split = sums.filter(F.col("m.n") < F.col("total")).select("key", F.col("m.c").alias("main"), F.col("m.n").alias("n_main"), "total")
        after = _common.cut(now.join(split, "key"), "placed")
        _common.discard(before)
        return after

    row = F.struct("r", "size", "c")
    links = links.unionByName(linked(placed.select("key", row.alias("a")), placed.groupBy("key").agg(F.min(row).alias("b"))))
    of = simhash.components(links)
    placed = still_split(of, placed)
    large = placed.filter(F.col("n_main") > block)
    if large.limit(1).count():
        chosen = large.filter("c = main").groupBy("key").agg(*[F.min(F.struct(F.xxhash64("r", F.lit(k)).alias("h"), row.alias("b"))).alias(f"b{k}") for k in range(LEADERS)])
        leaders = chosen.select("key", F.explode(F.array(*[f"b{k}.b" for k in range(LEADERS)])).alias("b"))
        links = links.unionByName(linked(large.filter("c <> main").select("key", row.alias("a")), leaders))
        of = simhash.components(links)
        placed = still_split(of, placed)
    if placed.limit(1).count():
        links = links.unionByName(_common.cut(_in_blocks(placed, texts, words, least, block), "links"))
        of = simhash.components(links)
    first = sets.join(of, sets["r"] == of["node"], "left").groupBy(F.coalesce("root", "r").alias("root")).agg(F.min("o").alias("o")).select(F.col("o.r").alias("_row"))
    first = _common.cut(first, "kept")
    for x in (sketches, placed):
        _common.discard(x)
    return rows.join(first, "_row", "left_semi").select("doc.*")
