"""Byte-level BPE, packing and TIFF pages: equal to the libraries, lossless, gapless."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from rankloom.llm import bpe, packing, tiff
from rankloom.llm._pieces import Memo, pieces

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def samples():
    rng = random.Random(9)
    for al in (["ab", "abc  \n"], ["the of and "], ["'s", "'re", "'ll x", "'"], ["é", "ü ß", " \t"], ["日本 ", "語🙂", "\r\n"], ["a"], ["12", " 3.5", " "]):
        for n in (0, 1, 3, 40, 400):
            yield "".join(rng.choice(al) for _ in range(n))


def test_codec(reference):
    c = bpe.Codec(RANKS, P.PATTERN)
    for x in samples():
        ids = c.encode(x)
        assert ids == reference.encode_ordinary(x) and c.decode(ids) == x.encode()
    with pytest.raises(ValueError):
        c.decode([60_000])


def test_pieces_can_be_encoded_alone(reference):
    for x in samples():
        first, rest = pieces(x)
        cut = [first, *[" " + y for y in rest]]
        assert "".join(cut) == x and sum((reference.encode_ordinary(y) for y in cut), []) == reference.encode_ordinary(x)


def check_bpe(rows, df, reference):
    texts = [r.text or "" for r in df.collect()]
    want = sorted((len(i := reference.encode_ordinary(x)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for x in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_bpe_operator(docs, edges, nothing, reference):
    for df in (docs, edges, nothing):
        check_bpe(bpe.encode(df, RANKS, P.PATTERN, keep_ids=False).collect(), df, reference)
    long = bpe.encode(edges.filter("doc_id = 10"), RANKS, P.PATTERN).first()
    assert np.frombuffer(long.ids, "<u4").tolist() == reference.encode_ordinary("idiot idiot idiot you are a moron") and long.decoded == b"idiot idiot idiot you are a moron"


def test_long_words(reference):
    """Words that are encoded in windows: runs, random letters, other scripts, and windows that must grow."""
    rng = random.Random(12)
    c = bpe.Codec(RANKS, P.PATTERN)
    letters = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    texts = ["x" * 70_000, letters("abcdefghijklmnopqrstuvwxyz", 100_000), "-" * 20_001, " " * 3000 + "a", "=" * 333, "語" * 5000, "ab" * 5000]
    texts += [letters(rng.choice(["ab", "aeiounrst", "=-", " \n", "xyzé", "語日本", "aaaaaab"]), rng.randint(60, 700)) for _ in range(40)]
    for x in texts:
        ids = c.encode(x)
        assert ids == reference.encode_ordinary(x) and c.decode(ids) == x.encode()


def test_decoding_in_parts():
    c = bpe.Codec(RANKS, P.PATTERN)
    texts = ["", "one two three", "é 語", "", "four " * 50]
    got = c.decode_texts(c.encode_pieces(texts), most=7)
    assert [b"".join(x) for x in got] == [x.encode() for x in texts]


def test_memo_forgets_but_stays_right():
    asked = []
    m = Memo(lambda xs: asked.extend(xs) or [x.encode() for x in xs], 3000)
    rng = random.Random(2)
    for _ in range(300):
        xs = {str(rng.randrange(60) ** 2) for _ in range(8)} | {"often", "z" * rng.choice([1, 500])}
        assert m.table(xs) == {x: x.encode() for x in xs}
        assert m.size <= 1500 and len(m.young) + len(m.old) < 40
    assert asked.count("often") == 1 and asked.count("z" * 500) > 1


def check_packing(df, rows, tokenizer):
    texts = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())
    ids = [np.array(e.ids + [0], "<u4") for e in tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)]
    total = sum(map(len, ids))
    assert sum(r.length for r in rows) == total
    pieces_ = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for x in ids:
        n, at, k = len(x), 0, 0
        size = n if n <= 2048 else n % 2048 or 2048
        while at < n:
            want.append((k, at, size, zlib.crc32(x[at : at + size].tobytes())))
            at, k, size = at + size, k + 1, 2048
    assert pieces_ == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins), -(-total // 2048)


def test_packing(docs, edges, nothing, tokenizer):
    got = packing.pack(packing.token_pieces(docs, JSON, P.PATTERN)).collect()
    made, least = check_packing(docs, got, tokenizer)
    assert made <= least * 1.02 + 1
    check_packing(edges, packing.pack(packing.token_pieces(edges, JSON, P.PATTERN), island_size=4).collect(), tokenizer)
    assert packing.pack(packing.token_pieces(nothing, JSON, P.PATTERN)).count() == 0


def test_packing_of_added_tokens(spark):
    """Texts that hold an added token of the file have the ids of the file's tokenizer as it is."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    assert whole.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b  c", "<|endoftext|><|endoftext|>\n x", "<|endoftext| >", "plain", "é <|endoftext|>" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(df, packing.pack(packing.token_pieces(df, JSON, P.PATTERN)).collect(), whole)


def test_ids_are_those_of_the_tokenizer():
    """Random texts over many scripts, and long runs, against the whole tokenizer."""
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(JSON), packing._encoder(JSON, P.PATTERN)
    rng = random.Random(14)
    alphabets = ["abc ", "A'sé \n", " \t\r\n\x0b\x0c\x1c\x85\u00a0\u2028\u3000a", "0123.,٣½Ⅷ²", "'sdmtllvere ", "语日本 한글ก็न", "🙂👍🏽\u200d\u0301e", "".join(map(chr, range(1, 0x300))), "_-=+*#<|>endoftx"]
    texts = ["".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.3 else al) for _ in range(rng.randint(0, 120))) for al in alphabets for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(300)]
    for x in [*texts, "x" * 20_000, " " * 5000, "ab" * 5000]:
        assert np.frombuffer(encode(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids, x[:200]


def test_genetic_steps():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    order = list(range(200))
    rng.shuffle(order)
    a, b = packing._packed(sizes, 100, order), packing._packed(sizes, 100, order[::-1])
    for child in (packing.crossover(a, b, 0.3, rng), packing.mutate(a, 5, rng), packing.evolve(sizes, 100, 1)):
        assert sorted(i for x in child.bins for i in x) == list(range(200))
        assert all(sum(sizes[i] for i in x) <= 100 and child.room[k] == 100 - sum(sizes[i] for i in x) for k, x in enumerate(child.bins))
    best = packing.crossover(a, b, 0.3, rng)
    full = min(range(len(b.bins)), key=lambda k: b.room[k])
    assert any(set(x) >= set(b.bins[full]) for x in best.bins), "the fullest bin of the other parent comes in whole"
    assert len(packing.evolve(sizes, 100, 1).bins) <= len(packing._packed(sizes, 100, sorted(order, key=lambda i: -sizes[i])).bins)
    assert packing.evolve([], 100, 1).bins == []


def test_a_migrant_bin_is_a_parent():
    """Pieces that came in one bin stay together in a first parent; full bins of it survive."""
    rng = random.Random(5)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    groups = [None if i >= 40 else i // 2 for i in range(80)]
    p = packing._of_groups(sizes, 130, groups)
    where = {i: k for k, x in enumerate(p.bins) for i in x}
    assert sorted(where) == list(range(80)) and all(where[2 * g] == where[2 * g + 1] for g in range(20)) and min(p.room) >= 0
    # The one perfect packing comes with the migrants only.
    sizes = [7, 3, 6, 4, 5, 5, 8, 2, 9, 1] * 20
    best = packing.evolve(sizes, 10, 1, [i // 2 for i in range(200)])
    assert len(best.bins) == 100


def test_epochs_migrate(spark, monkeypatch):
    """Open bins move whole: the elite to the next island, the others stay; pieces are lost by none."""
    rng = random.Random(6)
    rows = [(i, i, 0, 0, rng.randint(300, 1500), 1) for i in range(400)]
    found = spark.createDataFrame(rows, "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")
    seen = []
    real = packing._epoch
    monkeypatch.setattr(packing, "_epoch", lambda df, *a: seen.append(df.collect()) or real(df, *a))
    got = packing.pack(found, island_size=50).collect()
    assert sorted(r.doc_id for r in got) == list(range(400)) and len(seen) > 1
    for k in range(1, len(seen)):
        islands = {r.island for r in seen[k - 1]}
        where = {r.copy: r.island for r in seen[k - 1]}
        assert any(r.island != where[r.copy] for r in seen[k]) and len(islands) > 1
        bins = {}
        for r in seen[k]:
            bins.setdefault(r.group, set()).add((r.island, where[r.copy]))
        assert all(len(x) == 1 for x in bins.values())
    load = {}
    for r in got:
        load.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in load.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("name", ["packbits", "lzw"])
def test_codecs_round_trip(name):
    rng = random.Random(3)
    encode, decode = getattr(tiff, f"{name}_encode"), getattr(tiff, f"{name}_decode")
    for al in ([0], [1, 2], list(range(256)), [7, 7, 7, 8]):
        for n in (1, 2, 3, 127, 128, 129, 300, 4096, 20_000):
            x = bytes(rng.choice(al) for _ in range(n))
            assert decode(encode(x), n) == x


def test_all_ways_of_storing():
    rng = np.random.default_rng(1)
    for rows, width in ((1, 48), (17, 48), (100, 33)):
        image = rng.integers(0, 6, (rows, width), dtype=np.uint8)
        for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            for predictor in (1, 2):
                for shape in ({"rows": 7}, {"rows": 200}, {"tile": (16, 16)}, {"tile": (64, 32)}):
                    data = tiff.write_tiff([(image, {"compression": compression, "predictor": predictor, **shape})] * 2)
                    pages = [tiff.read_page(data, d) for d in tiff.directories(data)]
                    assert len(pages) == 2 and all((p == image).all() for p in pages)


def test_broken_files(spark):
    ok = tiff.write_tiff([(np.zeros((2, 48), np.uint8), {"compression": tiff.LZW, "rows": 2})])
    df = spark.createDataFrame([(1, bytearray(ok)), (2, bytearray(b"no")), (3, bytearray(ok[:20])), (4, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in tiff.tiff_pages(df).collect()}
    assert got[1].error is None and bytes(got[1].samples) == bytes(96) and all(got[k].error for k in (2, 3, 4))


def tiff_by_hand(order, tags, blocks, next_=0):
    """A file put together apart from the writer: blocks first, then long value lists, then one directory."""
    e = "<" if order == b"II" else ">"
    out, at = bytearray(order + struct.pack(e + "HI", 42, 0)), []
    for b in blocks:
        at.append(len(out))
        out += b
    entries = []
    for tag, kind, values in sorted(tags + [(273 if not any(t[0] == 322 for t in tags) else 324, 4, at), (279 if not any(t[0] == 322 for t in tags) else 325, 4, [len(b) for b in blocks])]):
        data = struct.pack(f"{e}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            data, where = struct.pack(e + "I", len(out)), data
            out += where
        entries.append(struct.pack(e + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
    struct.pack_into(e + "I", out, 4, len(out))
    return bytes(out + struct.pack(e + "H", len(entries)) + b"".join(entries) + struct.pack(e + "I", next_))


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_files_of_others(order):
    # The first rows of the LZW example of the format's specification: 7 7 7 8 8 7 7 6 6.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    size = [(256, 3, [3]), (257, 3, [3]), (277, 3, [1])]
    page = tiff.read_page(data := tiff_by_hand(order, size + [(258, 3, [8]), (259, 3, [5]), (278, 3, [3])], [lzw]), next(tiff.directories(data)))
    assert page.tolist() == [[7, 7, 7], [8, 8, 7], [7, 6, 6]]
    # PackBits: a literal and a run, after the specification's own example.
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    data = tiff_by_hand(order, [(256, 4, [24]), (257, 4, [1]), (258, 3, [8]), (259, 3, [32773]), (278, 4, [1])], [packed])
    assert tiff.read_page(data, next(tiff.directories(data))).tobytes().hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"
    # Two planes of two samples, deflate, horizontal predictor; and tiles of three samples that reach beyond the page.
    data = tiff_by_hand(order, [(256, 3, [2]), (257, 3, [2]), (277, 3, [2]), (258, 3, [8, 8]), (259, 3, [8]), (278, 3, [2]), (284, 3, [2]), (317, 3, [2])], [zlib.compress(bytes([1, 1, 5, 255])), zlib.compress(bytes([9, 0, 9, 1]))])
    assert tiff.read_page(data, next(tiff.directories(data))).tolist() == [[1, 9, 2, 9], [5, 9, 4, 10]]
    tile = lambda v: bytes([v] * 16 * 16 * 3)
    data = tiff_by_hand(order, [(256, 3, [17]), (257, 3, [16]), (277, 3, [3]), (258, 3, [8, 8, 8]), (322, 3, [16]), (323, 3, [16])], [tile(4), tile(6)])
    assert tiff.read_page(data, next(tiff.directories(data))).tolist() == [[4] * 48 + [6] * 3] * 16


def test_hostile_files(spark):
    base = [(256, 4, [48]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1]), (278, 4, [2])]
    change = lambda **new: [(t, k, new.get(f"t{t}", v)) for t, k, v in base] + [(int(n[1:]), 4, v) for n, v in new.items() if n[1:] not in {str(t) for t, *_ in base}]
    files = [change(t256=[0]), change(t278=[0]), change(t257=[1 << 31], t256=[1 << 31]), change(t317=[3]), change(t284=[7]), change(t257=[900], t278=[1]), change(t258=[16]), change(t277=[0])]
    rows = [(i, bytearray(tiff_by_hand(b"II", t, [bytes(96)]))) for i, t in enumerate(files)]
    rows.append((100, bytearray(tiff_by_hand(b"II", base, [bytes(range(96))], 99_999))))
    got = {}
    for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(len(got[i]) == 1 and got[i][0].error and got[i][0].samples is None for i in range(len(files)))
    good, bad = sorted(got[100], key=lambda r: r.page)
    assert bytes(good.samples) == bytes(range(96)) and good.error is None and bad.error and good.pages == bad.pages == 2


def test_text_pages(docs, edges, nothing):
    for df in (docs, edges, nothing):
        got = tiff.page_digests(tiff.text_pages(df)).collect()
        want = []
        for r in df.collect():
            b = (r.text or "").encode()
            p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
            want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
        assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert tiff.text_pages(edges.filter("doc_id = 8")).count() == 8
