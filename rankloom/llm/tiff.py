"""TIFF pages: a writer for byte payloads, and a reader that walks image directories and decodes strips and tiles.

The reader follows the chain of image directories (classic TIFF, both byte orders), decodes PackBits, LZW and deflate
strips and tiles, undoes the horizontal predictor, crops padded tiles and gives one row per page.  Pages have 8-bit
samples, one or more per pixel, chunky or in planes.

Defined results: null and empty texts have the payload of one unit of padding; equal texts give equal bytes; a page that
the reader can't decode, or that declares more than MOST samples, gives a row with an error text and no samples, and so does
a broken link to a further page; repeated rows give rows each; other columns are ignored.  page_digests() takes pages as the
operators give them and fails on a page with an error, which its own writer never makes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import _common

UNIT, PAD, WIDTH = 576, 255, 48
#: Tags and compression numbers of the format (fixed values).
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: "B", 3: "H", 4: "I"}
#: Samples of a page or block at most; a file that declares more gets an error row.
MOST = 1 << 28


def packbits_encode(data: bytes) -> bytes:
    out, n, i, lit = bytearray(), len(data), 0, 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(b, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    a = np.frombuffer(data, np.uint8)
    # Starts of runs of three or more equal bytes: the only ones worth a run.
    run = np.flatnonzero((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2])) if n > 2 else np.empty(0, int)
    for s in run.tolist():
        if s < i:
            continue
        e = s + 3
        while e < n and e - s < 128 and data[e] == data[s]:
            e += 1
        literal(lit, s)
        out += bytes((257 - (e - s), data[s]))
        i = lit = e
    literal(lit, n)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n and size > 0:
        c = data[i]
        if c < 128:
            part = data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            part = data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            part = b""
            i += 1
        out.append(part)
        size -= len(part)
    return b"".join(out)


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of nine to twelve bits, most significant bit first, as bytes."""
    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(w)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(12):
        has = w > k
        bits[ends[has] - 1 - k] = (c[has] >> k) & 1
    return np.packbits(bits).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes with early change; the table is cleared before it is full."""
    codes, widths, width = [256], [9], 9
    base = {bytes([i]): i for i in range(256)}
    table, next_code, prefix = dict(base), 258, b""
    for k in range(len(data)):
        grown = prefix + data[k : k + 1]
        if grown in table:
            prefix = grown
            continue
        codes.append(table[prefix])
        widths.append(width)
        table[grown] = next_code
        next_code += 1
        if next_code >= 4094:
            codes.append(256)
            widths.append(width)
            table, next_code, width = dict(base), 258, 9
        elif next_code >= 1 << width:
            width += 1
        prefix = data[k : k + 1]
    if prefix:
        codes.append(table[prefix])
        widths.append(width)
        next_code += 1
        if next_code >= 1 << width and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    return _pack_codes(codes, widths)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, pos, width = [], 0, 9
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, last, have, got, at = list(base), b"", 0, 0, 0
    while got < size:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            pos, at, have = ((pos << 8) | data[at]) & 0xFFFFFFFF, at + 1, have + 8
        have -= width
        code = (pos >> have) & ((1 << width) - 1)
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("an LZW code is out of place")
        out.append(word)
        got += len(word)
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


_ENCODE = {NONE: lambda x: x, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: packbits_encode}


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == LZW:
        return lzw_decode(data, size)[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)[:size]
    raise ValueError(f"compression {compression} is not known")


def write_tiff(pages: list[tuple[np.ndarray, dict]]) -> bytes:
    """pages: 8-bit arrays (rows, width), each with compression, predictor and either rows (of a strip) or tile (width, length)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image, how in pages:
        rows, width = image.shape
        tile = how.get("tile")
        if tile:
            tw, tl = tile
            padded = np.zeros((-(-rows // tl) * tl, -(-width // tw) * tw), np.uint8)
            padded[:rows, :width] = image
            blocks = [padded[y : y + tl, x : x + tw] for y in range(0, padded.shape[0], tl) for x in range(0, padded.shape[1], tw)]
        else:
            blocks = [image[y : y + how["rows"]] for y in range(0, rows, how["rows"])]
        offsets, counts = [], []
        for block in blocks:
            if how.get("predictor") == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = _ENCODE[how["compression"]](np.ascontiguousarray(block).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        tags = {IMAGE_WIDTH: [width], IMAGE_LENGTH: [rows], BITS: [8], COMPRESSION: [how["compression"]], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [how.get("predictor", 1)]}
        tags |= {TILE_WIDTH: [tile[0]], TILE_LENGTH: [tile[1]], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [how["rows"]], STRIP_COUNTS: counts}
        far = {}
        for t, v in tags.items():
            if len(v) > 1:
                far[t] = len(out)
                out += struct.pack(f"<{len(v)}I", *v)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for t, v in sorted(tags.items()):
            short = t in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR)
            out += struct.pack("<HHI", t, 3 if short else 4, len(v)) + (struct.pack("<I", far[t]) if t in far else struct.pack("<HH", v[0], 0) if short else struct.pack("<I", v[0]))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The tags of each image directory in the file's chain."""
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = "<" if data[:2] == b"II" else ">"
    if struct.unpack_from(e + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at, seen = struct.unpack_from(e + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(e + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            if kind not in _SIZES:
                continue
            code = _SIZES[kind]
            where = at + 10 + 12 * k
            if struct.calcsize(code) * count > 4:
                (where,) = struct.unpack_from(e + "I", data, where)
            tags[tag] = list(struct.unpack_from(f"{e}{count}{code}", data, where))
        yield tags
        (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """Samples of one page as (rows, width * samples); planes that are stored apart are put together."""
    rows, wide, spp = tags[IMAGE_LENGTH][0], tags[IMAGE_WIDTH][0], tags.get(SAMPLES, [1])[0]
    how, predictor, planar = (tags.get(t, [1])[0] for t in (COMPRESSION, PREDICTOR, PLANAR))
    tiled = TILE_OFFSETS in tags
    bw = tags[TILE_WIDTH][0] if tiled else wide
    bl = tags[TILE_LENGTH][0] if tiled else min(rows, tags.get(ROWS_PER_STRIP, [rows])[0])
    if any(b != 8 for b in tags.get(BITS, [8])):
        raise ValueError("only 8-bit samples are read")
    if min(rows, wide, spp, bw, bl) < 1 or rows * wide * spp > MOST or bl * bw * spp > MOST:
        raise ValueError("the page's size is out of bounds")
    if predictor not in (1, 2) or planar not in (1, 2):
        raise ValueError("the predictor or the planes' order is not known")
    planes = spp if planar == 2 else 1
    depth = spp // planes
    across, down = -(-wide // bw), -(-rows // bl)
    where, sizes = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    if min(len(where), len(sizes)) < planes * across * down:
        raise ValueError("blocks are missing")
    image = np.zeros((rows, wide, spp), np.uint8)
    for k, (at, count) in enumerate(zip(where[: planes * across * down], sizes)):
        plane, k = divmod(k, across * down)
        y, x = k // across * bl, k % across * bw
        high = bl if tiled else min(bl, rows - y)
        block = np.frombuffer(decode_block(data[at : at + count], how, high * bw * depth), np.uint8)
        if len(block) != high * bw * depth:
            raise ValueError("a block is short")
        block = block.reshape(high, bw, depth)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint8)
        image[y : y + high, x : x + bw, plane : plane + depth] = block[: rows - y, : wide - x]
    return image.reshape(rows, wide * spp)


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def plan_of(payload: bytes, page_rows: int = 192) -> list[tuple[np.ndarray, dict]]:
    """Pages of at most page_rows rows; how each is stored follows from the payload's checksum and the page's number."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    ways = [
        {"compression": DEFLATE, "predictor": 2, "tile": (WIDTH, 16)},
        {"compression": PACKBITS, "rows": 24},
        {"compression": DEFLATE, "rows": 64},
        {"compression": DEFLATE, "tile": (32, 32)},
        {"compression": PACKBITS, "tile": (16, 64)},
        {"compression": NONE, "rows": 48},
        {"compression": LZW, "predictor": 2, "tile": (WIDTH, 48)},
        {"compression": DEFLATE, "predictor": 2, "rows": 96},
    ]
    start = zlib.crc32(payload)
    return [(image[y : y + page_rows], ways[(start + k) % len(ways)]) for k, y in enumerate(range(0, len(image), page_rows))]


_PAGE = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
_PAGE_SQL = "doc_id long, copy long, n_bytes long, media_bytes long, media_sha256 string, page int, pages int, width int, height int, samples binary, error string"


def page_rows(doc_id, copy, n_bytes: int, media: bytes) -> list[tuple]:
    head = (doc_id, copy, n_bytes, len(media), hashlib.sha256(media).hexdigest())
    dirs, broken = [], None
    try:
        for tags in directories(media):
            dirs.append(tags)
    except (ValueError, struct.error) as e:
        # The pages before a broken link are read all the same.
        broken = str(e)
    pages = len(dirs) + (broken is not None)
    out = []
    for k, tags in enumerate(dirs):
        try:
            image = read_page(media, tags)
            out.append((*head, k, pages, image.shape[1], image.shape[0], image.tobytes(), None))
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
            out.append((*head, k, pages, 0, 0, None, str(e) or type(e).__name__))
    return out if broken is None else [*out, (*head, len(dirs), pages, 0, 0, None, broken)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of the TIFF files in a binary column; pages of a file follow each other."""

    def run(batches):
        for b in _common.slices(batches, "media"):
            rows = [r for d, c, m in zip(*(b.column(k).to_pylist() for k in range(3))) for r in page_rows(d, c, None, m or b"")]
            yield _table(rows, _PAGE)

    return _common.map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(media_col).alias("media")), run, _PAGE_SQL)


def text_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF file and reads the stored bytes back: one row per page, pages of a text follow each other."""

    def run(batches):
        for b in _common.slices(batches, "text"):
            rows = []
            for d, c, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                payload, n = payload_of(text)
                rows += page_rows(d, c, n, write_tiff(plan_of(payload)))
            yield _table(rows, _PAGE)

    return _common.map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text")), run, _PAGE_SQL)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_pages", pa.int32()), ("feature", pa.string())])


def feature(image: np.ndarray) -> str:
    """A histogram of sixteen grey levels, in 255ths, and an eight by eight brightness map against its mean, as hexadecimal digits."""
    grey = np.bincount(image.ravel() >> 4, minlength=16) * 255 // image.size
    edges = np.linspace(0, image.shape[0], 9).astype(int)
    cells = np.array([image[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) for a, b in zip(edges[:-1], edges[1:])])
    return grey.astype(np.uint8).tobytes().hex() + np.packbits(cells > cells.mean()).tobytes().hex()


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per file from its pages, which must follow each other as the operators give them; no shuffle."""

    def fold(rows: list[tuple]) -> tuple:
        d, _, n, size, sha = rows[0][:5]
        if any(r[10] for r in rows):
            raise ValueError(next(r[10] for r in rows if r[10]))
        data = b"".join(r[9] for r in rows)
        return d, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), size, sha, len(rows), feature(np.frombuffer(data, np.uint8).reshape(-1, rows[0][7]))

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                if held and held[0][1] != row[1]:
                    out.append(fold(held))
                    held = []
                held.append(row)
            if out:
                yield _table(out, _DIGEST)
        if held:
            yield _table([fold(held)], _DIGEST)

    return _common.map_batches(pages, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages int, feature string")
