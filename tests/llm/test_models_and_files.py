"""Media, archives, language, quality, licences and suffix dedup against brute force, round trips or held-out accuracy."""

import hashlib
import random
import re
from base64 import b32encode

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagemill.llm import jpeg, language, licenses, media, quality, suffixes, warc

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, sha string, payload string, h long, score double, n int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "p", 1, 0.5, 2) for i, t in texts], SCHEMA)


# ---------------------------------------------------------------- suffix dedup


def brute_dedup(texts, length):
    """Per row (doc_id, n_bytes, n_removed, n_spans, sha)."""
    docs, lead = [], {}
    for i, t in texts:
        b = (t or "").encode()
        lead.setdefault(i, set()).add((hashlib.sha256(b).hexdigest(), b))
    docs = sorted((i, min(s)[1]) for i, s in lead.items())
    seen, gone = set(), {}
    for i, b in docs:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                mask[p : p + length] = b"\1" * length
            seen.add(w)
        gone[i] = mask
    out = []
    for i, t in texts:
        b = (t or "").encode()
        mask = gone[i] if b == min(lead[i])[1] else bytearray(len(b))
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_texts():
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(["alpha", "é", "b", "gamma", "delta", "x1", "the"]) for _ in range(n))
    pool = [say(rnd.randint(5, 60)) for _ in range(12)]
    texts = []
    for i in range(120):
        texts.append((i, "".join(say(rnd.randint(0, 30)) + rnd.choice(pool) for _ in range(rnd.randint(0, 5)))))
    texts += [(200 + i, texts[i][1]) for i in range(0, 40, 3)]  # copies
    texts += [(300, "be " * 300), (301, "a" * 500), (302, "be " * 100 + "x"), (303, None), (304, ""), (305, "short")]
    near = say(80)
    texts += [(400 + i, near[: 20 + 5 * i] + "#" + near[20 + 5 * i :]) for i in range(40)]
    texts += [(500, near), (500, near), (501, near + "y"), (501, "another " * 40)]  # repeated ids
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("length", "hot", "block"), [(100, 1000, 200_000), (60, 3, 300), (100, 5, 40), (100, 1, 2)])
def test_suffix_dedup_matches_brute_force(spark, length, hot, block):
    texts = repeated_texts()
    out = sorted(tuple(r) for r in suffixes.dedup(frame(spark, texts), length, hot, block).collect())
    assert out == brute_dedup(texts, length)


def test_suffix_dedup_of_a_long_text(spark, monkeypatch):
    rnd = random.Random(9)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(70_000))
    texts = [(1, part * 2 + "end"), (2, "x" + part[1000:3000]), (3, part * 18)]
    out = {r.doc_id: tuple(r) for r in suffixes.dedup(frame(spark, texts)).collect()}
    assert out[1][:4] == (1, 140_003, 70_000, 1)
    assert out[2][2:4] == (2000, 1)
    assert out[3][2:4] == (70_000 * 18, 1)


def test_suffix_dedup_without_ids(spark):
    text = "a long enough text that occurs three times " * 5
    out = suffixes.dedup(frame(spark, [(None, text), (1, text), (2, text), (None, text), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed > 0) for r in out) == [(-1, 0, False), (-1, len(text), False), (-1, len(text), False), (1, len(text), True), (2, len(text), True)]


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_pieces_hold_every_window(monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 97)
    data = np.frombuffer(random.Random(1).randbytes(2000), np.uint8)
    offsets = np.array([0, 50, 50, 700, 2000])
    got = [(at + p, at + i) for at, place, inside, _ in suffixes.anchors(data, offsets, 60) for i, p in enumerate(place) if inside[i]]
    whole = {at + i: at + p for at, place, inside, _ in [next(suffixes.anchors(data, offsets, 60))] for i, p in enumerate(place) if inside[i]}
    windows = [i for a, b in zip(offsets, offsets[1:]) for i in range(a, b - 59)]
    assert sorted(i for _, i in got) == windows
    assert all(whole[i] == p for p, i in got if i in whole)


# ---------------------------------------------------------------- media


def test_jpeg_round_trip_and_slow_reader():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 5, 6, 7, 54, 300):
        payload = rnd.integers(0, 256, 64 * n).astype(np.uint8).tobytes()
        data = jpeg.encode(payload)
        fast, slow = jpeg.Image(data), jpeg.Image(data, fast=False)
        assert jpeg.payload_of(fast) == payload
        assert all((a.coef == b.coef).all() for a, b in zip(fast.parts, slow.parts))
        assert fast.rgb().shape == (fast.height, fast.width, 3)


def test_samples_match_the_textbook_transform():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 6).astype(np.uint8).tobytes()
    image = jpeg.Image(jpeg.encode(payload))
    c = lambda u: 2**-0.5 if u == 0 else 1.0
    plane = image.planes()[1]
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = image.parts[1].coef[0]
    for y, x in ((0, 0), (3, 5), (7, 7)):
        total = sum(c(u) * c(v) * block[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
        assert abs(int(plane[y, x]) - np.clip(total + 128, 0, 255)) <= 0.51
    r, g, b = image.rgb()[0, 0].astype(float)
    yy, cb, cr = (float(p[0, 0]) for p in image.planes())
    assert abs(r - np.clip(yy + 1.402 * (cr - 128), 0, 255)) <= 1.01
    assert abs(b - np.clip(yy + 1.772 * (cb - 128), 0, 255)) <= 1.01
    assert abs(g - np.clip(yy - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), 0, 255)) <= 1.01


class Writer:
    """A bit writer for hand-made scans."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def test_reader_of_general_scans():
    """A one-component file of odd size with restarts, runs of zeros, end-of-band runs, and coefficients that appear in refinement."""
    seg = jpeg._segment
    codes = bytes([0, 0, 0, 0, 0, 0, 0, 16] + [0] * 8)
    symbols = bytes([0, 1, 2, 3, 0x11, 0x10, 0x20, 0x21, 0xF0, 0x31, 4, 5, 6, 7, 8, 0x12])
    table = b"".join(seg(0xC4, bytes([k]) + codes + symbols) for k in (0, 0x10))
    code = {s: k for k, s in enumerate(symbols)}
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(1, 65))) + table + seg(0xC2, bytes([8, 0, 9, 0, 17, 1, 7, 0x11, 0])) + seg(0xDD, b"\0\4")
    # 17 x 9 samples: 3 x 2 blocks; a restart after four of them.
    dc = [3, -2, 0, 5, 1, 1]
    scans = head + seg(0xDA, bytes([1, 7, 0, 0, 0, 1]))
    for part in (dc[:4], dc[4:]):
        w, was = Writer(), 0
        for v in part:
            d, was = v - was, v
            size = abs(d).bit_length()
            w.put(code[size], 8)
            w.put(d if d >= 0 else d + (1 << size) - 1, size)
        scans += w.done() + (b"\xff\xd0" if len(part) == 4 else b"")
    scans += seg(0xDA, bytes([1, 7, 0, 0, 0, 0x10]))
    scans += bytes([0b10110000]) + b"\xff\xd0" + bytes([0b01000000])
    scans += seg(0xDA, bytes([1, 7, 0, 1, 63, 1]))
    w = Writer()
    w.put(code[0x11], 8), w.put(1, 1)  # block 0: k=2 is 1
    w.put(code[0xF0], 8), w.put(code[0x01], 8), w.put(0, 1)  # 16 zeros, k=19 is -1
    w.put(code[0x10], 8), w.put(0, 1)  # end of band for blocks 0 and 1
    w.put(code[0x12], 8), w.put(2, 2), w.put(code[0], 8)  # block 2: k=2 is 2
    w.put(code[0], 8)
    scans += w.done() + b"\xff\xd0"
    w = Writer()
    w.put(code[0x10], 8), w.put(0, 1)
    scans += w.done()
    scans += seg(0xDA, bytes([1, 7, 0, 1, 63, 0x10]))
    w = Writer()
    w.put(code[0x01], 8), w.put(1, 1)  # block 0: k=1 becomes 1
    w.put(code[0x21], 8), w.put(0, 1), w.put(1, 1)  # past k=2 (refined by 1) and two zeros: k=5 becomes -1
    w.put(code[0x10], 8), w.put(1, 1), w.put(1, 1)  # end of band for three blocks; k=19 refined
    w.put(0, 1)  # block 2: k=2 stays
    w.put(code[0], 8)
    scans += w.done() + b"\xff\xd0"
    w = Writer()
    w.put(code[0x10], 8), w.put(0, 1)
    scans += w.done() + b"\xff\xd9"
    image = jpeg.Image(scans)
    coef = image.parts[0].coef
    assert [int(v) for v in coef[:, 0]] == [7, -4, 1, 11, 2, 3]
    assert {(b, k): int(coef[b, k]) for b in range(6) for k in range(1, 64) if coef[b, k]} == {(0, 1): 1, (0, 2): 3, (0, 5): -1, (0, 19): -3, (2, 2): 4}
    assert image.rgb().shape == (9, 17, 3)


def test_stored_media_and_tensors(spark, monkeypatch):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 20_000), (1, "héllo"), (5, "a" * 64), (None, "no id"), (None, "none either")]
    docs = frame(spark, texts)
    one = sorted(map(tuple, media.digests(media.read(media.store(docs))).collect()), key=str)
    assert sorted(map(tuple, media.round_trip(docs).collect()), key=str) == one
    assert sorted(map(tuple, media.round_trip(docs, slice_bytes=100, slices=3).collect()), key=str) == one
    assert media.round_trip(docs.limit(0)).count() == 0


def test_media_columns(spark):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 200_000), (1, "héllo"), (5, "a" * 64)]
    out = media.digests(media.read(media.store(frame(spark, texts)))).collect()
    assert len(out) == 6
    import zlib

    for r in out:
        raw = (dict(texts)[r.doc_id] or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_sha256 == hashlib.sha256(jpeg.encode(whole)).hexdigest()
    tensors = media.read(media.store(frame(spark, texts)), tensors=True).collect()
    assert all(len(r.rgb) == 3 * r.height * r.width for r in tensors)
    assert media.read(media.store(frame(spark, texts).limit(0))).count() == 0


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    rows = [(i, f"http://x/{i % 7}", "payload %d é\r\n\r\nWARC/1.1\r\n" % (i % 5), "z", 1) for i in range(40)]
    rows += [(100, None, None, "z", 1), (101, "u r\nl", "", "z", 1), (102, "u", "single", "z", 1), (103, "u", "x" * 300_000, "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, value int")
    out = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(out) == len(rows)
    first = {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        lead = first.setdefault(raw, i)
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert r.intact
    none = spark.createDataFrame([(None, "u", "payload 1 é\r\n\r\nWARC/1.1\r\n"), (None, "u", "alone"), (None, "v", "alone"), (None, None, None), (7, "u", "payload 1 é\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, r.intact) for r in warc.round_trip(none).collect())
    assert found == [(0, 0, "response", 0, True), (0, 5, "response", 0, True), (0, 5, "response", 0, True), (0, 26, "revisit", 7, True), (7, 26, "response", 0, True)]
    long = {r.page_id: r for r in warc.round_trip(pages, least=10).collect()}
    assert long[101].record_type == "response" and long[39].record_type == "revisit"
    assert warc.round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- language and quality


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = F.col("doc_id") % 2 == 1
    profiles = language.prototypes(docs.where(~odd))
    out = language.predict(docs.where(odd), profiles).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()
    few = language.prototypes(docs.where(~odd), most_labelled=200)
    out = language.predict(docs.where(odd), few).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9


def test_language_edges(spark):
    rows = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the cat"), (4, "the cat"), (5, "漢字" * 50_000)])
    profiles = language.prototypes(spark.createDataFrame([("the cat sat", "en"), ("le chat", "fr"), (None, "xx"), ("zz", None)], "text string, lang string"))
    assert sorted(profiles) == ["en", "fr"]
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in language.predict(rows, profiles).collect())
    assert [x[1] for x in out][:5] == ["und", "und", "und", "en", "en"]
    assert len(out) == 6
    assert [r.lang_pred for r in language.predict(rows, {}).collect()] == ["und"] * 6
    assert language.predict(rows.limit(0), profiles).count() == 0


def test_trigram_store_keeps_its_bound():
    space, plain = language.Space(64, most=40), language.Space(64)
    for text in ("the quick brown fox", "jumps over the lazy dog " * 3, "ÀÉÎ漢字", "the quick brown fox"):
        assert np.allclose(space.bundle(text), plain.bundle(text), atol=1e-5)


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = F.col("doc_id") % 2 == 1
    model = quality.fit(docs, labels.where(~odd), most_labelled=1500)
    out = quality.score(docs, model).join(labels.where(odd), "doc_id").toPandas()
    pos, neg = out.score[out.quality == 1], out.score[out.quality == 0]
    auc = (pos.values[:, None] > neg.values[None, :]).mean()
    assert auc > 0.95
    assert (pos >= quality.THRESHOLD).mean() > 0.97


def test_quality_gradients():
    rnd = np.random.default_rng(0)
    x, bags, y = rnd.normal(size=(9, quality.WIDTH)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    shapes = [(quality.WIDTH, 5), (5,), (5, 3), (5, 3), (3,), (5,), (1,)]
    weights = [rnd.normal(0, 0.3, s) for s in shapes]
    loss = lambda w: -np.mean(np.log(np.where(y == 1, quality._forward(x, bags, w)[0], 1 - quality._forward(x, bags, w)[0])))
    for k, grad in enumerate(quality._gradients(x, bags, y, weights, 0.0)):
        at = tuple(rnd.integers(0, n) for n in weights[k].shape)
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x " * 100_000), (3, "y"), (4, "\n\n"), (5, "é")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(1, 0), (1, None), (9, 1), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} == {0.0}
    both = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, both)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.fit(docs, both)).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"The the the cat", "é — ".encode() * 300, b"x" * 2000, b" lead"]
    each = [quality.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    x, bags = quality.encode(np.frombuffer(b"".join(texts), np.uint8), ends)
    assert bags.tolist() == [int(b[0]) for _, b in each]
    assert np.allclose(x, np.concatenate([a for a, _ in each]))


# ---------------------------------------------------------------- licences


def brute_licenses(text):
    low = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    grams = lambda w: set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    if text is None:
        return None, 0.0, 0, ""
    segments = re.split(r"\r?\n", text) + [p for p in re.split(r"\r?\n[ \t]*\r?\n", text) if "\n" in p]
    found = []
    for s, line in enumerate(segments):
        a = grams(low(line))
        for k, (name, template) in enumerate(licenses.TEMPLATES):
            b = grams(low(template))
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licenses.LEAST:
                found.append((-dice, s, k, name))
    if not found:
        return None, 0.0, 0, ""
    return min(found)[3], round(-min(found)[0], 6), len({x[1] for x in found}), ",".join(sorted({x[3] for x in found}))


def test_licenses_match_brute_force(spark):
    names = [t for _, t in licenses.TEMPLATES]
    texts = [(i, "prose here\n" + t.upper() + "\nmore é prose") for i, t in enumerate(names)]
    texts += [(50 + i, t.replace(" ", "\n", 1)) for i, t in enumerate(names)]
    texts += [(90, None), (91, ""), (92, "Licensed under CC BY 4.0, you see."), (93, "mit license " * 30_000), (94, names[0] + "\r\n" + names[2]), (94, names[0]), (94, names[0])]
    texts += [(95, "x\n\n" + names[5].replace("free", "paid").replace(" the ", "\nthe ") + "\n \t\ny")]
    texts.append((None, names[1]))
    out = sorted((r.doc_id or -1, r.license or "", r.dice, r.n_segments, r.licenses) for r in licenses.report(frame(spark, texts)).collect())
    assert out == sorted((i or -1, (b := brute_licenses(t))[0] or "", *b[1:]) for i, t in texts)
    assert licenses.report(frame(spark, texts).limit(0)).count() == 0


# ---------------------------------------------------------------- long texts are taken in parts


def test_parts_do_not_change_results(monkeypatch):
    from usagemill.llm import simhash

    text = ("the Quick " * 700 + "é brown\tfox " * 900).encode()
    whole = simhash.simhash(text)
    blocks = simhash._blocks
    monkeypatch.setattr(simhash, "_blocks", lambda t: blocks(t, 50))
    assert simhash.simhash(text) == whole
    assert simhash.simhash(b"one two") == simhash.simhash(b"one  two\n") != 0 and simhash.simhash(b" \n") == 0
    payload = np.random.default_rng(2).integers(0, 256, 64 * 40_000).astype(np.uint8).tobytes()
    image = jpeg.Image(jpeg.encode(payload))
    rgb = image.rgb()
    y, cb, cr = image.planes()
    at = (image.height - 1, image.width - 1)
    r = np.clip(((int(y[at]) << 16) + (1 << 15) + 91881 * (int(cr[at[0] // 2, at[1] // 2]) - 128)) >> 16, 0, 255)
    assert rgb[at][0] == r and jpeg.payload_of(image) == payload


def test_long_documents_are_encoded_in_slices(monkeypatch):
    texts = [b"ab cd " * 800, b"", b"x" * 512, b"word " * 300]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    x, bags = quality.encode(data, offsets)
    monkeypatch.setattr(quality, "SLICE", 1024)
    y, more = quality.encode(data, offsets)
    assert bags.tolist() == more.tolist() == [10, 1, 1, 3]
    assert x.shape == y.shape and np.allclose(x, y, atol=1e-6)


def test_long_texts_of_a_language(monkeypatch):
    space = language.Space(64)
    texts = ["the cat sat on the mat " * 500, " 12 " * 300 + "Ünïcode" * 200 + "!?" * 400, "x", "", "a b" * 200]
    whole = [space.bundle(t) for t in texts]
    for chunk in (1, 2, 7, 300):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for a, t in zip(whole, texts):
            b = space.bundle(t)
            assert a is b is None or (a == b).all()


def plain_profile(text, width, seed=11):
    """The sum over trigrams, letter by letter."""
    letter = lambda c: np.random.default_rng([seed, ord(c)]).integers(0, 2, width) * 2.0 - 1
    said = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if said.strip() == "":
        return None
    total = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(said, said[1:], said[2:]))
    return total / (np.linalg.norm(total) or 1)


def test_language_matches_brute_force(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "Le chat s'est assis là", "fr"), (3, "12 !", "en"), (4, "the dog and the cat", "en"), (5, "où est le chat, mon ami", "fr"), (6, None, "fr"), (7, "über den Wolken", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    width = 64
    sums = {}
    for _, text, lang in rows:
        v = plain_profile(text, width) if text and lang else None
        if v is not None:
            sums[lang] = sums.get(lang, 0) + v
    proto = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    told = language.prototypes(docs, width)
    assert sorted(told) == sorted(proto) and all(np.allclose(told[k], proto[k], atol=1e-5) for k in proto)
    out = {r.doc_id: r for r in language.predict(docs, told, width).collect()}
    for i, text, _ in rows:
        v = plain_profile(text or "", width)
        if v is None:
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        cos = {k: float(p @ v) for k, p in proto.items()}
        best = max(sorted(cos), key=cos.get)
        assert out[i].lang_pred == best
        assert out[i].score == pytest.approx(1 / sum(np.exp(20 * (c - cos[best])) for c in cos.values()), rel=1e-4)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out_rows_of_the_queries(spark, sf):
    """Accuracy on the rows that op4 and op6 never learn from."""
    from usagemill.llm import queries

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op4_language(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").toPandas()
    assert len(out) > 2000 and (out.lang == out.lang_pred).mean() > 0.97
    out = queries.op6_quality(spark, sf).where("held_out").join(labels, "doc_id").toPandas()
    assert len(out) > 500 and (out.predicted == out.quality).mean() > 0.9


def test_quality_forward_matches_loops():
    """Gated attention, passage by passage, against the scores of whole batches."""
    rnd = np.random.default_rng(3)
    bags = np.array([3, 1, 5])
    x = rnd.normal(size=(9, quality.WIDTH))
    shapes = [(quality.WIDTH, 4), (4,), (4, 3), (4, 3), (3,), (4,), (1,)]
    w1, b1, v, u, w, c, d = weights = [rnd.normal(0, 0.3, s) for s in shapes]
    sig = lambda a: 1 / (1 + np.exp(-a))
    told, at = [], 0
    for n in bags:
        h = [np.maximum(row @ w1 + b1, 0) for row in x[at : at + n]]
        e = np.exp([float((np.tanh(k @ v) * sig(k @ u)) @ w) for k in h])
        told.append(sig(sum(a * k for a, k in zip(e / e.sum(), h)) @ c + d[0]))
        at += n
    assert np.allclose(quality.Model(0.0, 1.0, weights).score(x, bags), told)


def test_long_labelled_documents_are_learned_from(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "!!## $$ ") * (100 + 5000 * (i % 5 == 0))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = quality._features(docs.join(labels, "doc_id"), "quality", 8).collect()
    assert max(r.n for r in rows) == 8 and all(len(r.x) == 4 * quality.WIDTH * r.n for r in rows)
    model = quality.fit(docs, labels, most_passages=8)
    out = quality.score(docs, model).toPandas()
    assert ((out.score >= 0.5) == (out.doc_id % 2 == 1)).all()
