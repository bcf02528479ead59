"""Byte-level BPE encoding and decoding by recursive queries of an embedded DuckDB in each task.

Texts are cut by the pre-tokenizer pattern.  The distinct matches of a batch go into a DuckDB table of words, each a list of
single bytes' ids.  A recursive query takes the words apart into rows of (word, position, token), joins neighbours with the
merge table, contracts each word's leftmost pair of least rank and goes on until no word changes.  Results of words are
remembered in the worker, bounded in bytes, so that the query sees each frequent word once.  Decoding joins the ids of the
documents with the vocabulary and aggregates their bytes in order of position.

Long words: a word of over WINDOW bytes is encoded in windows that overlap by half, each a word of the same query.  Two
windows are stitched where both have a token's end and where the token on the left and the one on the right, encoded as one
word, stay as they are.  That gives the word's own encoding: a run of tokens is what contraction gives if and only if each
two neighbours alone are (the first contraction across an end would be made in the two alone as well).  A word whose windows
can't be stitched is encoded again in windows four times as wide, at last as a whole.  So n bytes cost n times a window's
rounds, not n rounds.

Memory: batches and windows are bounded, a round's rows are one list a word, and DuckDB never writes to disk.

Defined results: null and empty texts have no tokens; other columns are ignored; repeated rows are encoded each; ids that
cast to a long are kept as longs.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankloom.llm import _common
from rankloom.llm._pieces import Memo, PieceMemo, pieces

#: Bytes of a window of a long word.
WINDOW = 64

#: Each round: the neighbours that merge, the leftmost least of each word, and the lists of the words that changed.
_ENCODE = """
WITH RECURSIVE step(w, n, toks) AS (
  SELECT w, 0, toks FROM words_in
  UNION ALL
  SELECT s.w, s.n + 1, list_concat(list_append(s.toks[:b.i - 1], b.m), s.toks[b.i + 2:])
  FROM step s JOIN (
    SELECT w, (min(m * 1048576 + i) & 1048575)::INT AS i, (min(m * 1048576 + i) >> 20)::INT AS m
    FROM (
      SELECT w, unnest(range(1, len(toks))) AS i, unnest(toks[:len(toks) - 1])::BIGINT * 4294967296 + unnest(toks[2:]) AS pair FROM step
    ) JOIN merges USING (pair)
    GROUP BY w
  ) b USING (w)
)
SELECT w, arg_max(toks, n) AS ids FROM step GROUP BY w ORDER BY w
"""

#: Bytes are letters of Latin-1 here, since DuckDB aggregates text.
_DECODE = "SELECT i.part, string_agg(v.letters, '' ORDER BY i.p) AS letters, count(*) AS n FROM ids_in i JOIN vocabulary v USING (id) GROUP BY i.part ORDER BY i.part"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Codec:
    """Encodes and decodes with one rank file in one DuckDB connection."""

    def __init__(self, path: str, pattern: str, memory: str = "300MB", most: int = 64 << 20):
        ranks = load_ranks(path)
        self.pattern, self.window = regex.compile(pattern), WINDOW
        self.known = Memo(self.encode_words, most)
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        rows = [((ranks[t[:i]] << 32) + ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("pair", "m"), zip(*rows) if rows else ((), ()))})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "letters": [b.decode("latin-1") for b in ranks]})
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("table_in", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM table_in")
            self.db.unregister("table_in")

    def _query(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit numbers, by the recursive query."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        t = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if (t < 0).any():
            raise ValueError("the rank file lacks single bytes")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(t))
        self.db.register("words_in", pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "toks": lists}))
        found = self.db.sql(_ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("words_in")
        ids = found.column("ids").combine_chunks()
        at, flat = ids.offsets.to_numpy() * 4, ids.values.to_numpy().astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _batches(self, words: list[bytes], most_words: int = 30_000, most_bytes: int = 300_000) -> list[bytes]:
        out, k = [], 0
        while k < len(words):
            e, size = k, 0
            while e < len(words) and e - k < most_words and (size < most_bytes or e == k):
                size += len(words[e])
                e += 1
            out += self._query(words[k:e])
            k = e
        return out

    def _long(self, word: bytes, window: int) -> bytes:
        """The ids of a word of over `window` bytes."""
        n, step = len(word), window // 2
        if n <= window:
            return self._query([word])[0]
        starts = list(range(0, max(1, n - step), step))
        parts = [word[s : s + window] for s in starts]
        distinct = list(dict.fromkeys(parts))
        made = dict(zip(distinct, self._batches(distinct)))
        ids = [np.frombuffer(made[p], "<u4") for p in parts]
        ends = [s + np.cumsum(self.sizes[i]) for s, i in zip(starts, ids)]
        # Places where a window's token ends and the next window's token starts, those in the middle of both first.
        choices = []
        for k in range(len(starts) - 1):
            low, middle = starts[k + 1], starts[k + 1] + step // 2
            both = np.intersect1d(ends[k][:-1], np.r_[low, ends[k + 1][:-1]])
            choices.append(sorted(both[both >= low].tolist(), key=lambda p: (abs(p - middle), p)))
        stays: dict[tuple[int, int], bool] = {}
        cut = [-1] * len(choices)
        todo = list(range(len(choices)))
        turn = 0
        while todo:
            asked = {}
            for k in todo:
                if turn == len(choices[k]):
                    return self._long(word, window * 4)
                p = choices[k][turn]
                left = int(np.searchsorted(ends[k], p))
                right = int(np.searchsorted(ends[k + 1], p, "right"))
                asked[k] = (int(ids[k][left]), int(ids[k + 1][right]), left, right)
            new = list({a[:2]: word[choices[k][turn] - int(self.sizes[a[0]]) : choices[k][turn] + int(self.sizes[a[1]])] for k, a in asked.items() if a[:2] not in stays}.items())
            for (pair, _), got in zip(new, self._batches([b for _, b in new])):
                stays[pair] = got == np.array(pair, "<u4").tobytes()
            for k, a in asked.items():
                if stays[a[:2]]:
                    cut[k] = choices[k][turn]
            todo = [k for k in todo if cut[k] < 0]
            turn += 1
        out = []
        for k, i in enumerate(ids):
            first = int(np.searchsorted(ends[k], cut[k - 1], "right")) if k else 0
            last = int(np.searchsorted(ends[k], cut[k])) + 1 if k < len(cut) else len(i)
            out.append(i[first:last])
        return np.concatenate(out).astype("<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of matches of the pattern, as little-endian 32-bit numbers."""
        data = [x.encode() for x in words]
        out: list[bytes] = [b""] * len(data)
        short = [k for k, b in enumerate(data) if len(b) <= self.window]
        for k, ids in zip(short, self._batches([data[k] for k in short])):
            out[k] = ids
        for k, b in enumerate(data):
            if len(b) > self.window:
                out[k] = self._long(b, self.window)
        return out

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(x) for x in texts]
        get = self.known.table({w for ws in cut for w in ws}).__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_pieces([text])[0], "<u4").tolist()

    def decode_parts(self, ids: np.ndarray, sizes: list[int]) -> list[bytes]:
        """Bytes of runs of ids that follow each other, by ordered aggregation."""
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.db.register("ids_in", pa.table({"part": part, "p": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)}))
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids_in")
        if sum(found.column("n").to_pylist()) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(sizes)
        for k, x in zip(found.column("part").to_pylist(), found.column("letters").to_pylist()):
            out[k] = x.encode("latin-1")
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_parts(np.array(ids, np.int64), [len(ids)])[0]

    def decode_texts(self, ids: list[bytes], most: int = 400_000) -> list[list[bytes]]:
        """The bytes of each text's ids, in parts of bounded size."""
        out: list[list[bytes]] = [[] for _ in ids]
        held, owners, count = [], [], 0

        def flush() -> None:
            if held:
                for k, b in zip(owners, self.decode_parts(np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held])):
                    out[k].append(b)
            held.clear()
            owners.clear()

        for k, x in enumerate(ids):
            for a in range(0, len(x), 4 * most):
                part = x[a : a + 4 * most]
                if count + len(part) // 4 > most:
                    flush()
                    count = 0
                held.append(part)
                owners.append(k)
                count += len(part) // 4
        flush()
        return out


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[Codec, PieceMemo]:
    made = Codec(path, pattern)
    return made, PieceMemo(made.encode_pieces, 160 << 20)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: n_tokens, ids (little-endian 32-bit numbers, packed), decoded (the bytes that the ids stand for).

    With keep_ids=False the two byte columns are replaced by their SHA-256, so that they need not leave the task."""

    def digest(parts: list[bytes]) -> str:
        h = hashlib.sha256()
        for x in parts:
            h.update(x)
        return h.hexdigest()

    def run(batches):
        made, memo = codec(path, pattern)
        for b in _common.slices(batches, "text", 4 << 20):
            ids = memo.joined([pieces(x or "") for x in b.column(1).to_pylist()])
            decoded = made.decode_texts(ids)
            if keep_ids:
                columns = [pa.array(ids, pa.binary()), pa.array([b"".join(x) for x in decoded], pa.binary())]
            else:
                columns = [pa.array([digest([x]) for x in ids], pa.string()), pa.array([digest(x) for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *columns], names=names)

    names = ["doc_id", "n_tokens", "ids", "decoded"] if keep_ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = "binary" if keep_ids else "string"
    source = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return _common.map_batches(source, run, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")
