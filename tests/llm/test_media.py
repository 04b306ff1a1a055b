"""Lossless WebP round trips, hand-made streams, and media columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ringside.llm import media, webp
from ringside.llm.queries import op9_webp_media

OPTIONS = [
    {},
    {"palette": False},
    {"palette": False, "subtract_green": True},
    {"palette": False, "cache_bits": 4},
    {"cache_bits": 1},
    {"palette": False, "cross_colour": (37, -12, 90)},
    {"palette": False, "predictor": 5, "cross_colour": (1, 2, 3), "subtract_green": True, "cache_bits": 10},
    *[{"palette": False, "predictor": m} for m in range(14)],
]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_round_trips(options):
    r = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 5), (7, 3), (40, 33)):
        for p in (r.integers(0, 256, (h, w, 4)), r.integers(0, 2, (h, w, 4)), np.cumsum(r.integers(0, 3, (h, w, 4)), axis=1), np.full((h, w, 4), 7), np.repeat(r.integers(0, 9, (h, 1, 4)), w, axis=1)):
            p = p.astype(np.uint8)
            assert (webp.decode(webp.encode(p, **options)) == p).all()


def test_palettes_of_each_width():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 9, 16, 17, 200):
        colours = r.integers(0, 256, (n, 4)).astype(np.uint8)
        p = colours[r.integers(0, n, (50, 37))]
        assert (webp.decode(webp.encode(p)) == p).all()


def stream(put):
    w = webp.Writer()
    w.put(0x2F, 8)
    put(w)
    body = w.bytes() + b"\0"
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def simple(w, *symbols):
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    for s in symbols:
        w.put(s, 8)


def test_hand_made_meta_codes():
    """Two groups of codes chosen by an entropy image: the left block is green 10 or 20, the right one green 30."""

    def put(w):
        w.put(8 - 1, 14)
        w.put(1 - 1, 14)
        w.put(0, 1)
        w.put(0, 3)
        w.put(0, 1)  # no transform
        w.put(0, 1)  # no cache
        w.put(1, 1)
        w.put(0, 3)  # blocks of 4 pixels
        w.put(0, 1)
        simple(w, 0, 1)  # the group is in green and red
        for s in (0, 0, 255, 0):
            simple(w, s)
        w.put(0b10, 2)  # groups 0 and 1
        for first in ((10, 20), (30,)):
            simple(w, *first)
            for s in (1, 2, 255, 0):
                simple(w, s)
        w.put(0b0110, 4)

    p = webp.decode(stream(put))
    assert p[0, :, 1].tolist() == [10, 20, 20, 10, 30, 30, 30, 30]
    assert (p[0, :, [0, 2, 3]].T == [1, 2, 255]).all()


def test_hand_made_copies():
    """Distance codes reach the row above (code 1) and the pixel to the left (code 2); a copy may overlap itself."""

    def put(w):
        w.put(4 - 1, 14)
        w.put(3 - 1, 14)
        w.put(0, 1)
        w.put(0, 3)
        w.put(0, 3)  # no transform, no cache, no groups
        lengths = np.zeros(280, np.uint8)
        lengths[[5, 9]] = 2
        lengths[256 + 3] = 1  # length 4
        webp._put_code(w, lengths)
        for s in (0, 0, 255):
            simple(w, s)
        simple(w, 0, 1)
        code = webp.codes(lengths)
        for s in (5, 9, 5):
            w.put(code[s], 2)
        w.put(code[259], 1)
        w.put(1, 1)  # distance code 2: the pixel before, four times
        w.put(code[259], 1)
        w.put(0, 1)  # distance code 1: the row above
        w.put(code[9], 2)

    p = webp.decode(stream(put))
    assert p[:, :, 1].tolist() == [[5, 9, 5, 5], [5, 5, 5, 5], [5, 5, 5, 9]]


def test_bad_files():
    good = webp.encode(np.arange(4096, dtype=np.uint8).reshape(16, 64, 4))
    for bad in (b"", b"RIFFxxxxWEBP", good[:60], b"JUNK" + good[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_columns(spark):
    r = random.Random(1)
    texts = [None, "", "a", "x" * 63, "y" * 64, "z" * 70_000, "日本 é" * 50, "".join(r.choice("abc def\n") for _ in range(90_000)), "\0" * 200, "a"] * 2
    df = spark.createDataFrame([(i, t, 9, f"own {i}") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, __fields string").repartition(3)
    rows = {x["doc_id"]: x for x in media.digests(df).collect()}
    assert all(x["__fields"] == f"own {i}" for i, x in rows.items())  # a column of any name stays
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\0" * (64 - len(raw) % 64)
        x = rows[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (x["media_sha256"], x["feature"]) == (rows[i % 10]["media_sha256"], rows[i % 10]["feature"])
    kept = media.read(media.store(df)).collect()
    for x in kept:
        assert bytes(x["pixels"])[: len((x["text"] or "").encode())] == (x["text"] or "").encode()
        assert len(x["media"]) == rows[x["doc_id"]]["media_bytes"] and x["feature"] == rows[x["doc_id"]]["feature"]
    none = spark.createDataFrame([(None,)], "media binary")
    assert media.read(none).first()["pixels"] is None
    assert media.digests(df.limit(0)).count() == 0


def test_query_pads_to_the_next_multiple(spark, tmp_path):
    """Texts of a multiple of 64 bytes are payloads as they are; only empty ones are filled up from nothing."""
    texts = [None, "", "x" * 63, "y" * 64, "z" * 65, "\0" * 128, "é" * 32, "q" * 4096]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x["doc_id"]: x for x in op9_webp_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = rows[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_wide_images(monkeypatch):
    monkeypatch.setattr(webp, "MOST", 8)
    for n in (1, 511, 512, 513, 1500, 2048):
        for end in ("q", "\0" * 300):
            data = media.payload("q" * n + end)
            p = media.to_pixels(data)
            assert len(p) <= 8 and media.from_pixels(p) == data


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def get(self, n):
        out = 0
        for i in range(n):
            out |= (self.data[self.at >> 3] >> (self.at & 7) & 1) << i
            self.at += 1
        return out


def slow_code(lengths):
    """{(length, code read first bit highest): symbol}."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {(0, 0): used[0][1]}
    out, code, before = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - before
        out[n, code] = s
        code, before = code + 1, n
    return out


def slow_symbol(b, code):
    n = value = 0
    while (n, value) not in code:
        value, n = value << 1 | b.get(1), n + 1
    return code[n, value]


def slow_read_code(b, alphabet):
    lengths = [0] * alphabet
    if b.get(1):
        two = b.get(1)
        lengths[b.get(8 if b.get(1) else 1)] = 1
        if two:
            lengths[b.get(8)] = 1
        return slow_code(lengths)
    size = [0] * 19
    for s in webp.LENGTH_ORDER[: 4 + b.get(4)]:
        size[s] = b.get(3)
    code = slow_code(size)
    left = 2 + b.get(2 + 2 * b.get(3)) if b.get(1) else alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = slow_symbol(b, code)
        if s < 16:
            lengths[i], last, i = s, s or last, i + 1
        else:
            n = 3 + b.get(2) if s == 16 else 3 + b.get(3) if s == 17 else 11 + b.get(7)
            for _ in range(n):
                lengths[i], i = last if s == 16 else 0, i + 1
    return slow_code(lengths)


def slow_number(b, symbol):
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + b.get(extra) + 1


def slow_image(b, width, height, main):
    """Pixels as (alpha, red, green, blue), one at a time."""
    cache_bits = b.get(4) if b.get(1) else 0
    cache = [(0, 0, 0, 0)] * (1 << cache_bits)
    assert not (main and b.get(1))
    codes = [slow_read_code(b, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    out = []

    def put(p):
        out.append(p)
        if cache_bits:
            a, r, g, u = p
            cache[(0x1E35A7BD * (a << 24 | r << 16 | g << 8 | u) & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < width * height:
        s = slow_symbol(b, codes[0])
        if s < 256:
            red, blue, alpha = (slow_symbol(b, c) for c in codes[1:4])
            put((alpha, red, s, blue))
        elif s < 280:
            n = slow_number(b, s - 256)
            d = slow_number(b, slow_symbol(b, codes[4]))
            d = d - 120 if d > 120 else max(1, webp.NEAR[d - 1][0] + webp.NEAR[d - 1][1] * width)
            for _ in range(n):
                put(out[-d])
        else:
            put(cache[s - 280])
    return [out[i : i + width] for i in range(0, len(out), width)]


def slow_decode(data):
    """A plain decoder of streams without groups of codes, pixel by pixel."""
    b = Bits(data[20:])
    assert b.get(8) == 0x2F
    width, height = b.get(14) + 1, b.get(14) + 1
    b.get(4)
    steps, w = [], width
    while b.get(1):
        kind = b.get(2)
        if kind < 2:
            bits = b.get(3) + 2
            steps.append((kind, w, bits, slow_image(b, -(-w >> bits), -(-height >> bits), False)))
        elif kind == 2:
            steps.append((kind, w, 0, None))
        else:
            n = b.get(8) + 1
            table, last = [], (0, 0, 0, 0)
            for p in slow_image(b, n, 1, False)[0]:
                last = tuple((x + y) & 255 for x, y in zip(p, last))
                table.append(last)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, w, bits, table))
            w = -(-w >> bits)
    rows = slow_image(b, w, height, True)
    signed = lambda x: x - 256 if x > 127 else x
    for kind, w, bits, extra in reversed(steps):
        if kind == 3:
            each = 8 >> bits
            rows = [[extra[row[x >> bits][2] >> ((x & ((1 << bits) - 1)) * each) & ((1 << each) - 1)] for x in range(w)] for row in rows]
        elif kind == 2:
            rows = [[(a, (r + g) & 255, g, (u + g) & 255) for a, r, g, u in row] for row in rows]
        elif kind == 1:
            for y, row in enumerate(rows):
                for x, (a, r, g, u) in enumerate(row):
                    _, red_blue, to_blue, to_red = extra[y >> bits][x >> bits]
                    r = (r + (signed(to_red) * signed(g) >> 5)) & 255
                    row[x] = a, r, g, (u + (signed(to_blue) * signed(g) >> 5) + (signed(red_blue) * signed(r) >> 5)) & 255
        else:
            flat = [p for row in rows for p in row]
            for i, p in enumerate(flat):
                y, x = divmod(i, w)
                left, top, corner, right = (flat[i - k] if i >= k else None for k in (1, w, w + 1, w - 1))
                mode = extra[y >> bits][x >> bits][2]
                half = lambda p, q: tuple((m + n) >> 1 for m, n in zip(p, q))
                clamp = lambda m: max(0, min(255, m))
                if i == 0:
                    q = (255, 0, 0, 0)
                elif y == 0:
                    q = left
                elif x == 0:
                    q = top
                elif mode == 11:
                    q = left if sum(abs(t - c) for t, c in zip(top, corner)) < sum(abs(m - c) for m, c in zip(left, corner)) else top
                elif mode == 12:
                    q = tuple(clamp(m + t - c) for m, t, c in zip(left, top, corner))
                elif mode == 13:
                    q = tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner))
                else:
                    q = {0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top), 8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right))}[mode]
                flat[i] = tuple((m + n) & 255 for m, n in zip(p, q))
            rows = [flat[i : i + w] for i in range(0, len(flat), w)]
    return np.array([[(r, g, u, a) for a, r, g, u in row] for row in rows], np.uint8)


def images():
    r = np.random.default_rng(6)
    noise = lambda h, w, n: r.integers(0, n, (h, w, 4)).astype(np.uint8)
    smooth = np.cumsum(noise(20, 30, 3), axis=1, dtype=np.uint8)
    tinted = smooth.copy()
    tinted[:, :, 0], tinted[:, :, 2] = smooth[:, :, 1] // 2 + 9, smooth[:, :, 1] + smooth[:, :, 0]
    few = r.integers(0, 256, (300, 4)).astype(np.uint8)
    text = media.to_pixels(media.payload("".join(r.choice(list("etaoin shr"), 900)) * 3))
    return {"noise": noise(20, 16, 256), "rows": np.tile(noise(1, 16, 256), (30, 1, 1)), "text": text, "smooth": smooth, "tinted": tinted, "few": few[r.integers(0, 300, (40, 32)) ** 2 // 300], "palette": noise(9, 16, 2), "one": noise(1, 1, 256)}


@pytest.mark.parametrize("name", list(images()))
def test_streams_equal_plain_decoder(name):
    pixels = images()[name]
    for options in ({}, {"palette": False}, *(OPTIONS[2:] if name in ("smooth", "few") else [])):
        data = webp.encode(pixels, **options)
        assert (slow_decode(data) == pixels).all() and (webp.decode(data) == pixels).all()


def test_choices_by_cost(monkeypatch):
    """Each part of the format is used where it pays, and copies and cache beside each other are read."""
    kinds = {}
    for name, pixels in images().items():
        found = []
        monkeypatch.setattr(webp, "_transforms", lambda p, f=webp.__dict__["_transforms"]: found.append(f(p)) or found[-1])
        monkeypatch.setattr(webp, "_tokens", lambda *a, f=webp.__dict__["_tokens"]: found.append(f(*a)) or found[-1])
        webp.encode(pixels, palette=name == "palette")
        monkeypatch.undo()
        kinds[name] = found
    assert kinds["smooth"][0][0] is not None and kinds["tinted"][0][1] is not None and kinds["noise"][0] == (None, None, False)
    assert len(kinds["rows"][-1][3]) and len(kinds["text"][-1][3])  # copies
    assert kinds["few"][-1][0]  # cache
    assert len(webp.encode(images()["text"])) < 0.5 * len(webp.encode(images()["noise"])) * images()["text"].size / images()["noise"].size

    def put(w):
        w.put(4 - 1, 14)
        w.put(2 - 1, 14)
        w.put(0, 1)
        w.put(0, 4)  # version, no transform
        w.put(1, 1)
        w.put(1, 4)  # a cache of two slots
        w.put(0, 1)
        lengths = np.zeros(282, np.uint8)
        lengths[[5, 256 + 1, 280, 281]] = 2
        webp._put_code(w, lengths)
        for s in (0, 0, 255, 1):
            simple(w, s)
        code = webp.codes(lengths)
        for s in (5, 280, 281, 257, 5, 280, 281):
            w.put(code[s], 2)

    data = stream(put)
    assert (webp.decode(data) == slow_decode(data)).all()


def test_distinct_values_and_codes_of_few_symbols():
    r = np.random.default_rng(11)
    for n in (0, 1, 2, 5, 300):
        for dtype in (np.uint32, np.uint64):
            values = r.integers(0, 60, n).astype(dtype)
            assert webp._distinct(values) == len(set(values.tolist()))
    for _ in range(200):
        counts = r.integers(0, 50, 19) * (r.random(19) < 0.6)
        size = webp.code_lengths(counts)
        want = [f"{c:0{n}b}" if n else "" for c, n in zip(webp.codes(size).tolist(), size.tolist(), strict=True)]
        assert webp._few_codes(size.tolist()) == want


def test_damaged_images_raise_or_give_pixels():
    """Positions beyond the last bit count as the last one: no damage leads outside of the image."""
    r = random.Random(12)
    data = webp.encode(media.to_pixels(media.payload("".join(r.choice("etaoin shrdlu.") for _ in range(3000)), 0)))
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(60, len(bad))] ^= 1 << r.randrange(8)
        cut = bytes(bad[: r.randrange(60, len(bad))]) if r.random() < 0.5 else bytes(bad)
        try:
            assert webp.decode(cut).shape[2] == 4
        except ValueError:
            pass
