"""SimHash components, MinHash fingerprints and removal of repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import fingerprints, near_copies, simhash, suffix_dedup


def plain_simhash(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, pairs):
    p = list(range(n))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return [f(x) for x in range(n)]


def check_components(rows):
    rows = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows]
    c = classes(len(rows), [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if bin(a[1] ^ b[1]).count("1") <= 4])
    for k in set(c):
        ids = [rows[i][0] for i in range(len(rows)) if c[i] == k and rows[i][0] is not None]
        assert {rows[i][2] for i in range(len(rows)) if c[i] == k} == {min(ids) if ids else None}


def test_simhash_query(docs):
    got = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) and all(int(r.fingerprint, 16) == plain_simhash(texts[r.doc_id]) for r in got)
    check_components(got)


def test_simhash_edges(edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    check_components(got)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 4, 5)} == {1, 3}
    assert kept.filter("doc_id = 1").count() == 1


@pytest.mark.parametrize("bucket", [3, 200_000])
def test_links_of_clusters(spark, bucket):
    """A cluster of near copies, in buckets that are split and in whole ones."""
    rng = random.Random(bucket)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    place = {x: i for i, x in enumerate(signed)}
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, bucket).collect()
    want = [(i, j) for i, a in enumerate(fps) for j in range(i) if bin(a ^ fps[j]).count("1") <= 4]
    assert classes(len(fps), [(place[r.a], place[r.b]) for r in got]) == classes(len(fps), want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 40))


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_edit_report(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    follow = dict(zip(ids, ids[1:] + ids[:1]))
    got = fingerprints.edit_report(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    off = []
    for r in got:
        edited = fingerprints.edited(texts[r.doc_id], texts[follow[r.doc_id]])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(texts[r.doc_id])
        a, b = shingles(texts[r.doc_id]), shingles(edited)
        off.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.05


def test_edit_report_edges(edges, nothing):
    got = fingerprints.edit_report(edges).collect()
    assert len(got) == edges.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert fingerprints.edit_report(nothing).count() == 0
    assert {r.fingerprint for r in fingerprints.fingerprints(edges.filter("doc_id IN (1, 2)")).collect()} == {r.fingerprint for r in got if r.doc_id == 1}


def test_spliced_words():
    one, rng = fingerprints.OnePermutation(), random.Random(2)
    rnd = lambda: "".join(rng.choice(["a", "B ", " ", "\n", "é ", "x y", "\x1c"]) for _ in range(rng.choice([0, 1, 2, 5, 30])))
    for _ in range(3000):
        t, f = rnd(), rnd()
        half = len(t) // 2
        a, b = t[: len(t) - half].encode(), f[:half].encode()
        got = fingerprints.spliced(one, fingerprints.Hashed(one, t), len(a), fingerprints.Hashed(one, f), len(b))
        assert got.tolist() == one.word_hashes((a + b).lower().split()).tolist()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_likeness_estimate(bits):
    one, rng = fingerprints.OnePermutation(1024, bits), random.Random(4)
    words = [str(rng.random()) for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:2500])
    sa, sb = shingles(a), shingles(b)
    assert one.likeness(one(a), one(b)) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.09)
    assert one.likeness(one(a), one(a)) == 1


def plain_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return data, out


def check_removed(df, got, length):
    rows = df.select("doc_id", "text").collect()
    data, gone = plain_removed([r.text for r in rows], length)
    want = Counter()
    for r, b, g in zip(rows, data, gone):
        edges = np.diff(np.r_[0, g.astype(int), 0])
        want[r.doc_id, len(b), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_dedup(docs):
    check_removed(docs, suffix_dedup.report(docs).collect(), 200)


@pytest.mark.parametrize("most", [2, 300])
def test_suffix_dedup_small_strings(spark, most):
    """Short strings over a small alphabet: many contexts of one anchor, gathered or halved."""
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcd") for _ in range(rng.randint(20, 60))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        rows.append((i, "".join(parts)[: rng.randint(0, 150)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_removed(df, suffix_dedup.report(df, length=24, k=8, most=most).collect(), 24)


def test_suffix_dedup_edges(edges, nothing):
    df = edges.withColumn("spans", F.lit("mine")).withColumn("_did", F.lit(77))
    check_removed(df, suffix_dedup.report(df, length=20, k=6).collect(), 20)
    assert suffix_dedup.report(nothing).count() == 0
    kept = suffix_dedup.strip(df, length=20, k=6)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert kept.select("spans", "_did").distinct().collect() == [("mine", 77)]
    assert kept.filter("doc_id = 1").first().text == "" and kept.filter("doc_id = 3").first().text is None


def test_anchors_do_not_depend_on_the_place():
    """Equal strings have equal anchors wherever they stand, ties of hashes included."""
    rng = random.Random(7)
    for al in (b"a", b"ab", bytes(range(256))):
        part = bytes(rng.choice(al) for _ in range(90))
        want = None
        for before in (0, 1, 7, 13, 14, 15, 29, 100):
            text = bytes(rng.choice(b"xyz") for _ in range(before)) + part + b"end"
            _, place, ah, _ = suffix_dedup.anchors([text], 20, 6)
            # Windows that lie inside the part have their anchors there.
            lead = [(p - before, h) for p, h in zip(place.tolist(), ah.tolist()) if before + 20 <= p < before + 60]
            want = want or lead
            assert lead and lead == want


def test_near_copies_in_blocks(spark):
    """Many texts that share most of a passage, and fall short of the threshold or just reach it, in blocks of a few."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            own[at] = f"x{rng.random()}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for x in texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    c = classes(len(texts), near)
    assert 3 < len(set(c)) < 70
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, _row int")
    for block in (4, 256):
        got = near_copies.keep_first(df, block=block)
        assert got.columns == df.columns and {r._row for r in got.collect()} == {1}
        assert sorted(r.doc_id for r in got.collect()) == sorted(set(c))


def test_close_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)] + [np.array([1], np.uint64)]
    classes_ = rng.integers(0, 12, 31)
    want = [(i, j) for i in range(31) for j in range(i) if classes_[i] != classes_[j] and near_copies.similarity(sets[i], sets[j]) >= 0.5]
    for width in (7, 4096):
        a, b = near_copies.close_pairs(sets, classes_, 0.5, width)
        assert classes(31, zip(a.tolist(), b.tolist())) == classes(31, want) and set(zip(b.tolist(), a.tolist())) <= set(want)


def test_suffix_sort():
    rng = random.Random(8)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    buf = np.frombuffer(data, np.uint8)
    h = suffix_dedup.Hashes(buf)
    at = np.array(rng.sample(range(400), 150))
    size = np.minimum(60, 400 - at)
    group = np.sort(np.array([rng.randrange(4) for _ in at]))
    order = suffix_dedup.merge_sort(h, at, size, group, 60)
    assert [(group[i], data[at[i] : at[i] + size[i]]) for i in order] == sorted((group[i], data[at[i] : at[i] + size[i]]) for i in range(150))


def test_collisions_are_verified(monkeypatch):
    """With hashes that always agree, the exact comparison decides."""
    monkeypatch.setattr(suffix_dedup.Hashes, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    contexts = [b"xxAAAAyy", b"xzAAAAyw", b"qqAAAAqq"]
    got = suffix_dedup.shared_strings(contexts, np.array([2, 2, 2]), np.zeros(3, int), 6, 4)
    assert (got == suffix_dedup._exact(contexts, np.array([2, 2, 2]), np.zeros(3, int), 6, 4)).all()


def test_near_copies_of_the_pipeline(spark):
    """Copies of similarity 0.5 to 1, short and blank texts: what stays is what brute force over all pairs leaves."""
    import corpus_pipeline

    rng = random.Random(11)
    texts = ["", " \n", None, "One two", "one TWO", "one two three four five six", "one two three four five six seven"]
    for c in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(own))
    sets = []
    for x in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(bin(plain_simhash(texts[i]) ^ plain_simhash(texts[j])).count("1") > 4 for i, j in near) > 5
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    c = classes(len(texts), near)
    df = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(d for d, k in zip(ids, c) if k == g) for g in set(c))


def test_near_copies_of_the_tries(spark, monkeypatch):
    """The pipeline's stage joins the tries of the fingerprints: its pairs connect what all pairs within four bits connect."""
    import corpus_pipeline

    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 300, 20)] + [" ".join(f"y{rng.randrange(3000)}" for _ in range(300)) for _ in range(5)]
    found, links = [], simhash.links

    def seen(prints, *more):
        found.append(([r.fp for r in prints.collect()], [(r.a, r.b) for r in links(prints, *more).collect()]))
        return links(prints, *more)

    monkeypatch.setattr(simhash, "links", seen)
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").orderBy("doc_id").collect()] == [0, 15, 16, 17, 18, 19]
    prints, got = found[0]
    assert sorted(x & (1 << 64) - 1 for x in prints) == sorted({simhash.of_hashes(near_copies.shingles(x)) for x in texts})
    near = [(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints[:i]) if bin((x ^ y) & (1 << 64) - 1).count("1") <= 4]
    assert near and classes(len(prints), near) == classes(len(prints), [(prints.index(a), prints.index(b)) for a, b in got])
