"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents become lists of token ids and one end id; only documents longer than a sequence are cut, into whole sequences
behind a first piece that takes the remainder.  Whole sequences stand alone.  The other pieces are dealt to islands of a
few thousand.  An island keeps a small population of packings; crossover injects whole well-filled bins of one parent
into the other, removes the bins that hold a piece twice and puts the displaced pieces into the tightest bins that take
them.  After an epoch the full bins of an island's best packing are closed.  Of its other bins the better filled half, its
elite, migrates to the neighbour island, whole, with the pieces in them; there they make up a parent for crossover, together
with the bins that stayed.  As pieces leave, islands become fewer, so that what islands leave over is packed together.  The
last epoch closes all bins.

Islands are groups of bounded size, nothing but counts goes to the driver, and each epoch ends in a table in the shared
folder.

Defined results: null and empty texts are one piece that holds the end id alone; rows that repeat an id are packed each
(their pieces can be told apart by `copy`); a null id is a document like any other; ids are cast to longs.
"""

from __future__ import annotations

import functools
import json
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as they are, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in plain]
    return {x: x for x in plain} | {x: 256 + k for k, x in enumerate(others)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text, as little-endian 32-bit numbers, by a file of the tokenizers library.

    Where the file is a plain byte-level BPE whose merges stand in the order of their tokens' ids, tiktoken makes the same
    ids from its vocabulary in a fifth of the time and without a memory of words (the tests compare both).  It knows no added
    tokens, so texts that hold one go through the whole tokenizer, as do all texts for any other file."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    vocabulary, merges = model.get("vocab"), model.get("merges")
    letters = {chr(c): b for b, c in _byte_letters().items()}
    plain = model.get("type") == "BPE" and tokenizer.normalizer is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
    if plain:
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        rest = [i for t, i in vocabulary.items() if len(t) > 1 and t not in added]
        plain = made == sorted(set(rest)) and all(c in letters for t in vocabulary if t not in added for c in t)
    if not plain:
        return whole
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> bytes:
        if any(t in text for t in added):
            return whole(text)
        return np.array(encoding.encode_ordinary(text), "<u4").tobytes()

    return ids


def token_pieces(df: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, length, ids_crc32.  copy tells rows with the same id apart."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer, pattern)
        for b in _common.slices(batches, "text"):
            out = []
            for doc, copy, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    out.append((doc, copy, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*out), _PIECE)] if out else [pa.array([], y.type) for y in _PIECE], schema=_PIECE)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    return _common.map_batches(source, run, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


_PIECE = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Packing:
    """Bins of item numbers, their free room, and the bins in order of room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.order: list[tuple[int, int]] = []

    def inject(self, items: list[int]) -> None:
        k = len(self.bins)
        self.bins.append(items)
        self.room.append(self.capacity - sum(self.sizes[i] for i in items))
        insort(self.order, (self.room[k], k))

    def best_fit(self, i: int) -> None:
        at = bisect_left(self.order, (self.sizes[i], -1))
        if at == len(self.order):
            self.inject([i])
            return
        room, k = self.order.pop(at)
        self.bins[k].append(i)
        self.room[k] = room - self.sizes[i]
        insort(self.order, (self.room[k], k))

    def fitness(self) -> float:
        """Mean squared fill: of two packings with as many bins, the one with fuller bins is better."""
        c = self.capacity
        return sum(((c - r) / c) ** 2 for r in self.room) / max(1, len(self.room))


def _packed(sizes: list[int], capacity: int, order: list[int]) -> Packing:
    p = Packing(sizes, capacity)
    for i in order:
        p.best_fit(i)
    return p


def crossover(a: Packing, b: Packing, share: float, rng: random.Random) -> Packing:
    """The fullest bins of b enter whole; bins of a that hold one of their items are dissolved and the rest is best-fitted."""
    child = Packing(a.sizes, a.capacity)
    ranked = sorted(range(len(b.bins)), key=lambda k: (b.room[k], k))
    taken: set[int] = set()
    for k in ranked[: max(1, int(share * len(ranked)))]:
        child.inject(list(b.bins[k]))
        taken.update(b.bins[k])
    displaced = []
    for items in a.bins:
        if taken.isdisjoint(items):
            child.inject(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    for i in sorted(displaced, key=lambda i: (-a.sizes[i], rng.random())):
        child.best_fit(i)
    return child


def mutate(p: Packing, count: int, rng: random.Random) -> Packing:
    """The emptiest bins and a few others are dissolved and best-fitted anew."""
    ranked = sorted(range(len(p.bins)), key=lambda k: -p.room[k])
    out = set(ranked[: max(1, count)]) | set(rng.sample(range(len(p.bins)), min(len(p.bins), count)))
    child = Packing(p.sizes, p.capacity)
    for k, items in enumerate(p.bins):
        if k not in out:
            child.inject(list(items))
    for i in sorted((i for k in out for i in p.bins[k]), key=lambda i: (-p.sizes[i], rng.random())):
        child.best_fit(i)
    return child


def _of_groups(sizes: list[int], capacity: int, groups: list[int | None]) -> Packing:
    """Pieces that came in one bin stay together, the others are best-fitted."""
    bins: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        if g is not None:
            bins.setdefault(g, []).append(i)
    p = Packing(sizes, capacity)
    for items in bins.values():
        p.inject(items)
    for i in sorted((i for i, g in enumerate(groups) if g is None), key=lambda i: -sizes[i]):
        p.best_fit(i)
    return p


def evolve(sizes: list[int], capacity: int, seed: int, groups: list[int | None] | None = None, population: int = 5, generations: int = 12) -> Packing:
    """The best packing that an island finds; it stops at the lower bound of bins with one bin short of full at most.

    groups: for each piece the bin that it came to the island in, which makes up one of the first parents."""
    rng = random.Random(seed)
    items = list(range(len(sizes)))
    people = [_packed(sizes, capacity, sorted(items, key=lambda i: -sizes[i]))]
    if groups is not None and any(g is not None for g in groups):
        people.append(_of_groups(sizes, capacity, groups))
    least = -(-sum(sizes) // capacity)
    done = lambda p: len(p.bins) <= least and sum(r > 0 for r in p.room) <= 1
    if not items or done(people[0]):
        return people[0]
    while len(people) < population:
        noise = 0.1 * len(people)
        people.append(_packed(sizes, capacity, sorted(items, key=lambda i: -sizes[i] * (1 + noise * rng.random()))))
    for _ in range(generations):
        people.sort(key=lambda p: (len(p.bins), -p.fitness()))
        if done(people[0]):
            break
        a, b = people[0], people[1 + rng.randrange(max(1, len(people) // 2))] if len(people) > 1 else people[0]
        child = crossover(a, b, rng.uniform(0.2, 0.6), rng)
        people[-1] = mutate(child, 1 + len(child.bins) // 50, rng)
    return min(people, key=lambda p: (len(p.bins), -p.fitness()))


_BIN = "doc_id long, copy long, piece int, length long, epoch int, island int, bin int, offset long, open boolean, elite boolean"


def _epoch(rows: DataFrame, epoch: int, last: bool, capacity: int) -> DataFrame:
    """Rows (with island, and group: the bin that a piece came in) with their bin, whether it stays open, and whether it is of the elite."""

    def one(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        sizes = table.column("length").to_pylist()
        best = evolve(sizes, capacity, 1000 * epoch + key[0].as_py(), table.column("group").to_pylist())
        open_ = [not last and r > 0 for r in best.room]
        ranked = sorted((k for k, o in enumerate(open_) if o), key=lambda k: (best.room[k], k))
        elite = set(ranked[: len(ranked) // 2])
        n = len(sizes)
        where, offset = [0] * n, [0] * n
        for k, items in enumerate(best.bins):
            at = 0
            for i in items:
                where[i], offset[i] = k, at
                at += sizes[i]
        return pa.table({**{c: table.column(c) for c in ("doc_id", "copy", "piece", "length")}, "epoch": pa.array([epoch] * n, pa.int32()), "island": pa.array([key[0].as_py()] * n, pa.int32()), "bin": pa.array(where, pa.int32()), "offset": pa.array(offset, pa.int64()), "open": pa.array([open_[k] for k in where], pa.bool_()), "elite": pa.array([k in elite for k in where], pa.bool_())})

    # A given number of partitions, since tasks by bytes would put many islands, which cost time and not bytes, into one.
    n = _common.partitions_for(rows.sparkSession)
    return rows.select("doc_id", "copy", "piece", "length", "island", "group").repartition(n, "island").groupBy("island").applyInArrow(one, _BIN)


def pack(found: DataFrame, capacity: int = 2048, island_size: int = 2000, epochs: int = 4) -> DataFrame:
    """Adds sequence_id and offset to what token_pieces() gave."""
    rows = _common.cut(found, "pieces")
    parts, todo = [], rows.filter(F.col("length") < capacity)
    left = todo.count()
    islands = max(1, -(-left // island_size))
    todo = todo.select("doc_id", "copy", "piece", "length", F.pmod(F.xxhash64("copy", "piece"), F.lit(islands)).cast("int").alias("island"), F.lit(None).cast("long").alias("group"))
    for e in range(epochs):
        last = e == epochs - 1 or islands == 1
        made = _common.cut(_epoch(todo, e, last, capacity), f"epoch{e}")
        parts.append(made.filter(~F.col("open")))
        if last:
            break
        rest = made.filter("open")
        left = rest.count()
        if not left:
            break
        # The elite goes one island on; where islands become fewer, they are folded, bins whole.
        islands = max(1, min(islands, -(-left // island_size)))
        to = F.pmod(F.col("island") + F.col("elite").cast("int"), F.lit(islands)).cast("int")
        todo = rest.select("doc_id", "copy", "piece", "length", to.alias("island"), (F.col("island").cast("long") * F.lit(1 << 20) + F.col("bin")).alias("group"))
    bins = functools.reduce(DataFrame.unionByName, [p.select("copy", "piece", "epoch", "island", "bin", "offset") for p in parts])
    # A bin's number: epoch, island and place on the island in one; whole sequences have negative numbers.
    placed = bins.select("copy", "piece", "offset", ((F.col("epoch").cast("long") * F.lit(1 << 31) + F.col("island")) * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"))
    alone = rows.filter(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.filter(F.col("length") < capacity).join(placed, ["copy", "piece"]).select(*alone.columns).unionByName(alone)
