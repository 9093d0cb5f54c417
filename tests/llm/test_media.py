"""The WebP decoder against images written here with every feature, and the round trip of texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sapwood.llm import media, webp, webp_batch, webp_encode


class Writer:
    """A plain writer of the format: fixed-length codes, chosen transforms, back-references and cache hits."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, alphabet, used):
        """A code for the used symbols, written as code lengths; gives symbol -> (bits, length)."""
        used = sorted(used)
        if len(used) == 1:
            self.put(1, 1)
            self.put(0, 1)
            wide = used[0] > 1
            self.put(wide, 1)
            self.put(used[0], 8 if wide else 1)
            return {used[0]: (0, 0)}
        top = (len(used) - 1).bit_length()
        short = (1 << top) - len(used)  # so many symbols may be one bit shorter
        lengths = [0] * alphabet
        for i, s in enumerate(used):
            lengths[s] = top - (i < short)
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        out, code, before = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - before
            out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code, before = code + 1, n
        return out

    def image(self, pixels, width, main, cache_bits=0, groups=None, rng=None):
        """Entropy-coded pixels; with rng, some runs become back-references and some pixels cache hits."""
        self.put(cache_bits > 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        height = len(pixels) // width
        if main:
            self.put(groups is not None, 1)
            if groups is not None:
                cell, which = groups
                self.put(cell - 2, 3)
                self.image([w << 8 for w in which], (width + (1 << cell) - 1) >> cell, False)
        cache, tokens, at = {}, [], 0
        key = lambda p: (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
        while at < len(pixels):
            start, done = at, False
            if rng and at and rng.random() < 0.5:
                back = rng.choice([1, width, 2, width + 1, rng.randint(1, at)])
                n = 0
                while back <= at and at + n < len(pixels) and n < 300 and pixels[at + n] == pixels[at + n - back]:
                    n += 1
                if n:
                    tokens.append((at, "copy", n, back))
                    at, done = at + n, True
            if not done and cache_bits and cache.get(key(pixels[at])) == pixels[at]:
                tokens.append((at, "cache", key(pixels[at]), 0))
                at, done = at + 1, True
            if not done:
                tokens.append((at, "pixel", pixels[at], 0))
                at += 1
            if cache_bits:
                for p in pixels[start:at]:
                    cache[key(p)] = p

        def prefix(v):  # value from 1 -> symbol, extra bits, number of them
            v -= 1
            if v < 4:
                return v, 0, 0
            high = v.bit_length() - 1
            half = v >> (high - 1) & 1
            return 2 * high + half, v & ((1 << (high - 1)) - 1), high - 1

        def far(back):
            for i, (x, y) in enumerate(webp.NEAR):
                if max(x + y * width, 1) == back:
                    return i + 1
            return back + 120

        def group_of(i):
            if not main or groups is None:
                return 0
            cell, which = groups
            return which[(i // width >> cell) * ((width + (1 << cell) - 1) >> cell) + (i % width >> cell)]

        count = max(groups[1]) + 1 if main and groups is not None else 1
        used = [[set() for _ in range(5)] for _ in range(count)]
        for i, kind, v, back in tokens:
            u = used[group_of(i)]
            if kind == "pixel":
                for k, s in enumerate((8, 16, 0, 24)):
                    u[k].add(v >> s & 255)
            elif kind == "cache":
                u[0].add(280 + v)
            else:
                u[0].add(256 + prefix(v)[0])
                u[4].add(prefix(far(back))[0])
        codes = [[self.code(a, u or {0}) for a, u in zip((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), g, strict=True)] for g in used]
        for i, kind, v, back in tokens:
            c = codes[group_of(i)]
            if kind == "pixel":
                for k, s in enumerate((8, 16, 0, 24)):
                    self.put(*c[k][v >> s & 255])
            elif kind == "cache":
                self.put(*c[0][280 + v])
            else:
                s, extra, n = prefix(v)
                self.put(*c[0][256 + s])
                self.put(extra, n)
                s, extra, n = prefix(far(back))
                self.put(*c[4][s])
                self.put(extra, n)

    def file(self):
        body = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def read(file):
    """The pixels of one file, which the decoder of many images must read alike."""
    alone, (among,) = webp.decode(file), webp_batch.decode_many([file])
    assert np.array_equal(alone, among)
    return alone.ravel().tolist()


def features(file):
    """What a file is made of: transforms, cache, back-references."""
    bits = webp.Bits(webp.payload_of(file))
    width, height = webp.read_header(bits)
    undo, inner = webp.read_transforms(bits, width, height)
    found = {("predictor", "cross-colour", "green", "palette")[t[0]] for t in undo}
    head = webp_batch._Head(file)
    if head.cache:
        found.add("cache")
    look, origin = webp_batch._window([head])
    codes = webp_batch._code_tables([head], webp_batch._read_codes([head], look, origin))
    if codes[2][:4].any() and (webp_batch._tokens([head], look, origin, *codes)[2] > 0).any():
        found.add("back-reference")
    return found


def started(width, height):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def picture(width, height, colours, seed):
    rng = random.Random(seed)
    palette = [rng.getrandbits(32) for _ in range(colours)]
    out = []
    for i in range(width * height):
        out.append(out[i - width] if i >= width and rng.random() < 0.5 else out[i - 1] if i and rng.random() < 0.4 else rng.choice(palette))
    return out


def minus(a, b):
    return sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))


def test_back_references_colour_cache_and_groups():
    for seed, cache, groups in ((1, 0, None), (2, 5, None), (3, 8, (2, [0, 1, 2, 1, 0, 2])), (4, 0, (3, [1, 0]))):
        width, height = (11, 7) if groups and groups[0] == 2 else (13, 8)
        pixels = picture(width, height, 9, seed)
        w = started(width, height)
        w.put(0, 1)
        w.image(pixels, width, True, cache, groups, random.Random(seed))
        assert read(w.file()) == pixels


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 9, 6
    pixels = picture(width, height, 40, mode)
    modes = [mode << 8] * 6
    rest = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        guess = 0xFF000000 if not i else pixels[i - 1] if not y else pixels[i - width] if not x else webp.PREDICT[mode](
            pixels[i - 1],
            pixels[i - width],
            pixels[i - width + 1],
            pixels[i - width - 1],
        )
        rest.append(minus(p, guess))
    w = started(width, height)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    w.image(modes, 3, False)
    w.put(0, 1)
    w.image(rest, width, True)
    assert read(w.file()) == pixels


def test_predictor_formulas_on_known_values():
    left, top, right, corner = 0xFF102030, 0xFF203040, 0xFF405060, 0xFF182838
    assert webp.PREDICT[7](left, top, right, corner) == 0xFF182838
    assert webp.PREDICT[11](left, top, right, corner) in (left, top)
    assert webp.PREDICT[12](0xFFF0F0F0, 0xFFF0F0F0, 0, 0xFF000000) == 0xFFFFFFFF
    assert webp.PREDICT[13](0xFF101010, 0xFF101010, 0, 0xFF202020) == 0xFF080808
    assert webp.PREDICT[13](0xFF101010, 0xFF101010, 0, 0xFF131313) == 0xFF0F0F0F  # halves go towards zero


def test_cross_colour_and_subtract_green():
    width, height = 8, 8
    pixels = picture(width, height, 30, 5)
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    g2r, g2b, r2b = 0x30, 0xE1, 0x7F
    stored = []
    for p in pixels:
        r, g, b = p >> 16 & 255, p >> 8 & 255, p & 255
        r2 = r - (signed(g2r) * signed(g) >> 5) & 255
        b2 = b - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5) & 255
        stored.append((p & 0xFF000000) | (r2 - g & 255) << 16 | g << 8 | (b2 - g & 255))
    w = started(width, height)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)
    w.image([r2b << 16 | g2b << 8 | g2r], 1, False)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    w.image(stored, width, True)
    assert read(w.file()) == pixels


@pytest.mark.parametrize("colours", [2, 3, 11, 60])
def test_palette(colours):
    width, height = 10, 5
    pixels = picture(width, height, colours, colours)
    palette = sorted(set(pixels))
    bits = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    inner, each = (width + (1 << bits) - 1) >> bits, 8 >> bits
    packed = []
    for y in range(height):
        row = [palette.index(p) for p in pixels[y * width : (y + 1) * width]]
        for x in range(inner):
            packed.append(sum(v << (k * each) for k, v in enumerate(row[x << bits : (x + 1) << bits])) << 8)
    w = started(width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(len(palette) - 1, 8)
    w.image([minus(p, q) for p, q in zip(palette, [0, *palette], strict=False)], len(palette), False)
    w.put(0, 1)
    w.image(packed, inner, True)
    assert read(w.file()) == pixels


def payloads():
    rng = np.random.default_rng(4)
    smooth = np.cumsum(rng.integers(-1, 2, (40, 64)), 0).astype(np.uint8)  # each row near the one above
    green = rng.integers(0, 100, 1600).astype(np.int64)
    tied = np.stack([np.full(1600, 9), green // 2, green, green // 4], 1)
    return {
        "zeros": b"\0" * 64, "few": b"ab" * 32, "steps": bytes(range(256)) * 3, "noise": rng.integers(0, 256, 64 * 300, dtype=np.uint8).tobytes(),
        "lines": ("Ünïcödé text " * 900).encode().ljust(64 * 300, b"\0"), "skewed": bytes(int(x) for x in np.minimum(rng.geometric(0.3, 64 * 70), 255)),
        "smooth": smooth.tobytes(), "tied": tied.astype(np.uint8).tobytes(), "long": bytes(
            rng.integers(97, 123, 400, dtype=np.uint8)
        ) * 200, "one": b"x",
    }


def test_samples_round_trip_alone_and_together():
    rows = [p.ljust(-(-len(p) // 64) * 64, b"\0") for p in payloads().values()]
    files = webp_encode.encode_samples(rows)
    assert [d.astype(">u4").tobytes() for d in webp_batch.decode_many(files)] == rows
    assert [webp.decode(f).astype(">u4").tobytes() for f in files] == rows
    assert webp_encode.encode_samples(rows[3:5]) == files[3:5]  # neighbours change nothing
    assert webp_encode.encode_samples([]) == [] == webp_batch.decode_many([])


def test_the_encoder_takes_what_pays():
    names = list(payloads())
    used = dict(zip(names, map(features, webp_encode.encode_samples(list(payloads().values()))), strict=True))
    assert used["smooth"] >= {"predictor"} and used["tied"] & {"cross-colour", "green"} and used["few"] >= {"palette"} and "back-reference" in used["long"]


def test_features_of_the_tables_texts():
    """Files of documents need back-references, the colour cache and palettes; all come from the encoder's own choice."""
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]
    rows = [media.payload(t)[1] for t in texts]
    files = webp_encode.encode_samples(rows)
    count = {}
    for f in files:
        for name in features(f):
            count[name] = count.get(name, 0) + 1
    assert count["back-reference"] > len(rows) / 2 and count["cache"] > len(rows) / 2 and count["palette"] > 0
    assert sum(map(len, files)) < 0.6 * sum(map(len, rows))
    assert all(p.astype(">u4").tobytes() == r for p, r in zip(webp_batch.decode_many(files), rows, strict=True))


def test_images_of_any_size_round_trip():
    rng = random.Random(8)
    images = [np.array(picture(w, h, n, w), np.uint32).reshape(h, w) for w, h, n in ((1, 1, 1), (7, 3, 2), (33, 21, 5), (50, 9, 40), (3, 200, 17), (600, 5, 300))]
    images.append(np.array([rng.getrandbits(32) for _ in range(35)], np.uint32).reshape(5, 7))
    for image, back in zip(images, webp_batch.decode_many(webp_encode.encode_images(images)), strict=True):
        assert np.array_equal(image, back)


def test_torn_files_say_so():
    file = webp_encode.encode_samples([payloads()["noise"]])[0]
    for n in (10, 30, 200, len(file) // 2, len(file) - 40):
        assert isinstance(webp_batch.decode_many([file[:n]])[0], webp.Broken)


def test_long_codes_are_cut():
    counts = np.zeros(280, np.int64)
    counts[:30] = [2**i for i in range(30)]
    lengths = webp_encode.code_lengths(counts)
    assert lengths.max() <= webp_encode.LONGEST and (1 / 2.0 ** lengths[lengths > 0]).sum() == 1


def test_texts_and_broken_images(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "line\n" * 500, "x" * 64]
    docs = spark.createDataFrame([(i, t, b"mine") for i, t in enumerate(texts)], "doc_id long, text string, file binary")
    got = {r["doc_id"]: r["media"] for r in media.text_media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        m = got[i]
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (
            len(raw),
            len(want),
            hashlib.sha256(want).hexdigest(),
            zlib.crc32(want[-64:]),
        )
        assert (m["media_bytes"], m["media_sha256"]) == (len(m["file"]), hashlib.sha256(bytes(m["file"])).hexdigest())
    assert got[4] == got[6]
    bad = spark.createDataFrame(
        [(1, b"nothing"), (2, None), (3, webp_encode.encode_samples([b"q" * 64])[0]), (4, webp_encode.encode_samples([bytes(range(64))])[0][:60])],
        "id long, blob binary",
    )
    seen = {r["id"]: r["image"] for r in media.decode_images(bad, "blob").collect()}
    assert seen[1]["error"] and seen[4]["error"] and not seen[2]["error"] and seen[2]["width"] is None
    assert (seen[3]["width"], seen[3]["height"]) == (16, 1)
    assert media.decode_images(bad.limit(0), "blob").collect() == []
