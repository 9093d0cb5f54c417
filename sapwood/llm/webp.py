"""Lossless WebP in Python and numpy: the parts of a file, and a decoder of one image.

The format is that of RFC 9649. Pixels are 32-bit ARGB values. webp_batch.py decodes many images at
once, webp_encode.py writes them.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_MULTIPLIER, SIDE = 0x1E35A7BD, 1 << 14


class Broken(ValueError):
    """The bytes are no lossless WebP image."""


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Broken("the bits end early")
        return got


def code_table(lengths: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """(bits looked at, (symbol, length) for each value of these bits) of a canonical code."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if not used:
        raise Broken("a code without symbols")
    if len(used) == 1:
        return 0, [(used[0][1], 0)]
    most = used[-1][0]
    if sum(1 << (most - n) for n, _ in used) != 1 << most:
        raise Broken("a code that is not complete")
    plain = [(s, n) for n, s in used for _ in range(1 << (most - n))]
    return most, [plain[int(f"{i:0{most}b}"[::-1], 2)] for i in range(1 << most)]


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    out = [0] * alphabet
    if bits.read(1):  # simple: one or two symbols
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]:
            if symbol >= alphabet:
                raise Broken("a symbol outside the alphabet")
            out[symbol] = 1
        return out
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, at, before = code_table(first), 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = read_symbol(bits, table)
        if symbol < 16:
            out[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, n = (before, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise Broken("code lengths run over")
        out[at : at + n] = [value] * n
        at += n
    return out


def read_symbol(bits: Bits, table: tuple[int, list[tuple[int, int]]]) -> int:
    symbol, n = table[1][bits.peek(table[0])]
    bits.at += n
    if bits.at > bits.end:
        raise Broken("the bits end early")
    return symbol


def _prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _cells(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """One entropy-coded image: prefix codes, back-references and colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Broken("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    which, cell = None, 0
    if main and bits.read(1):
        cell = bits.read(3) + 2
        which = [p >> 8 & 0xFFFF for p in read_pixels(bits, _cells(width, cell), _cells(height, cell), False)]
    groups = [[code_table(read_lengths(bits, a)) for a in (280 + len(cache), 256, 256, 256, 40)] for _ in range(max(which) + 1 if which else 1)]
    out, total, across, cached = [], width * height, _cells(width, cell), 0
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = groups[which[(at // width >> cell) * across + (at % width >> cell)] if which else 0]
        symbol = read_symbol(bits, green)
        if symbol < 256:
            r, b, a = read_symbol(bits, red), read_symbol(bits, blue), read_symbol(bits, alpha)
            out.append(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 280:
            length = _prefix_value(bits, symbol - 256)
            code = _prefix_value(bits, read_symbol(bits, far))
            back = code - 120 if code > 120 else max(NEAR[code - 1][0] + NEAR[code - 1][1] * width, 1)
            if back > at or at + length > total:
                raise Broken("a back-reference outside the image")
            for i in range(at - back, at - back + length):
                out.append(out[i])
        else:
            while cached < at:
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[symbol - 280])
    return out


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _bytes(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _from(channels) -> int:
    a, r, g, b = (min(max(c, 0), 255) for c in channels)
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, corner: int) -> int:
    # the one nearer to left + top - corner: that lies |top - corner| from left and |left - corner| from top
    from_left = sum(abs(t - c) for t, c in zip(_bytes(top), _bytes(corner), strict=True))
    from_top = sum(abs(x - c) for x, c in zip(_bytes(left), _bytes(corner), strict=True))
    return left if from_left < from_top else top


def _half(x: int) -> int:
    return int(x / 2)  # towards zero


PREDICT = [
    lambda x, t, tr, tl: 0xFF000000,
    lambda x, t, tr, tl: x,
    lambda x, t, tr, tl: t,
    lambda x, t, tr, tl: tr,
    lambda x, t, tr, tl: tl,
    lambda x, t, tr, tl: _mean(_mean(x, tr), t),
    lambda x, t, tr, tl: _mean(x, tl),
    lambda x, t, tr, tl: _mean(x, t),
    lambda x, t, tr, tl: _mean(tl, t),
    lambda x, t, tr, tl: _mean(t, tr),
    lambda x, t, tr, tl: _mean(_mean(x, tl), _mean(t, tr)),
    lambda x, t, tr, tl: _select(x, t, tl),
    lambda x, t, tr, tl: _from(a + b - c for a, b, c in zip(_bytes(x), _bytes(t), _bytes(tl), strict=True)),
    lambda x, t, tr, tl: _from(m + _half(m - c) for m, c in zip(_bytes(_mean(x, t)), _bytes(tl), strict=True)),
]


def undo_predictor(pixels: np.ndarray, width: int, height: int, cell: int, modes: list[int]) -> np.ndarray:
    """Pixels from what their predictions left. Images with one mode, left or top, are running sums."""
    used = {m >> 8 & 15 for m in modes}
    if used <= {1} or used <= {2}:
        left = np.array(pixels, np.int64).astype("<u4").view(np.uint8).reshape(height, width, 4)
        left[0, 0, 3:] -= 1  # the first pixel is predicted as opaque black
        np.cumsum(left[0], axis=0, dtype=np.uint8, out=left[0])
        if used <= {1}:
            np.cumsum(left[:, 0], axis=0, dtype=np.uint8, out=left[:, 0])
            np.cumsum(left[1:], axis=1, dtype=np.uint8, out=left[1:])
        else:
            np.cumsum(left, axis=0, dtype=np.uint8, out=left)
        return left.reshape(-1).view("<u4").astype(np.int64)
    pixels = [int(p) for p in pixels]
    out, across = list(pixels), _cells(width, cell)
    for i in range(width * height):
        y, x = divmod(i, width)
        if not i:
            guess = 0xFF000000
        elif not y:
            guess = out[i - 1]
        elif not x:
            guess = out[i - width]
        else:
            mode = modes[(y >> cell) * across + (x >> cell)] >> 8 & 15
            # the pixel right above the last column's is the first of this row
            guess = PREDICT[mode](out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1]) if mode < 14 else 0xFF000000
        out[i] = _add(pixels[i], guess)
    return np.array(out, np.int64)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, cell: int, factors: list[int]) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    f = np.array(factors, np.int64)[(y >> cell) * _cells(width, cell) + (x >> cell)]
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    p = pixels.astype(np.int64)
    green = signed(p >> 8)
    red = (p >> 16 & 255) + (signed(f) * green >> 5) & 255
    blue = (p & 255) + (signed(f >> 8) * green >> 5) & 255
    blue = blue + (signed(f >> 16) * signed(red) >> 5) & 255
    return (p & 0xFF00FF00) | red << 16 | blue


def payload_of(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("no WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise Broken("no lossless image")


def read_header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise Broken("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Broken("unknown version")
    return width, height


Transform = tuple[int, int, int, list[int]]


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list[Transform], int]:
    """The transforms in the order of the file, each (kind, width, cell or packing bits, values), and the width of the stored pixels."""
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Broken("a transform twice")
        seen.add(kind)
        if kind < 2:
            cell = bits.read(3) + 2
            undo.append((kind, inner, cell, read_pixels(bits, _cells(inner, cell), _cells(height, cell), False)))
        elif kind == 2:
            undo.append((kind, inner, 0, []))
        else:
            size = bits.read(8) + 1
            palette, before = [], 0
            for p in read_pixels(bits, size, 1, False):
                before = _add(p, before)
                palette.append(before)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, inner, packed, palette))
            inner = _cells(inner, packed)
    return undo, inner


def undo_transforms(pixels: np.ndarray, height: int, undo: list[Transform]) -> np.ndarray:
    """The image's pixels (uint32, row by row) from the stored ones."""
    for kind, w, cell, extra in reversed(undo):
        if kind == 0:
            pixels = undo_predictor(pixels, w, height, cell, extra)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, w, height, cell, extra)
        elif kind == 2:
            p = pixels.astype(np.int64)
            g = p >> 8 & 255
            pixels = (p & 0xFF00FF00) | ((p >> 16 & 255) + g & 255) << 16 | ((p & 255) + g & 255)
        else:
            p = (pixels.astype(np.int64) >> 8 & 255).reshape(height, -1)
            x = np.arange(w)
            index = p[:, x >> cell] >> ((x & ((1 << cell) - 1)) * (8 >> cell)) & ((1 << (8 >> cell)) - 1)
            pixels = np.array(extra + [0] * (256 - len(extra)), np.int64)[index].ravel()
    return pixels.astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """The image's ARGB values (uint32, height x width)."""
    bits = Bits(payload_of(data))
    width, height = read_header(bits)
    undo, inner = read_transforms(bits, width, height)
    pixels = np.array(read_pixels(bits, inner, height, True), np.int64)
    return undo_transforms(pixels, height, undo).reshape(height, width)
