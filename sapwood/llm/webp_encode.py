"""Lossless WebP files from pixel arrays, many images at a time in numpy.

Of each image's transforms the one is taken that saves most by the entropy of the channels: a
palette (16 colours at most, several pixels packed in one), a predictor, cross-colour, subtracted
green. Repeated pixel runs become back-references, pixels that the colour cache holds become
cache codes, the rest literals; each image has prefix codes of its own.
"""

from __future__ import annotations

import struct

import numpy as np

from .webp import CACHE_MULTIPLIER, LENGTH_ORDER, SIDE

#: Longest code of an image, and of the code that its code lengths are written in.
LONGEST, LONGEST_FIRST = 11, 7
#: Pixels of the shortest back-reference; pixels of the longest; farthest distance.
SHORTEST, FURTHEST, FARTHEST = 3, 4096, (1 << 20) - 120
#: A transform is taken if the channels' entropy falls to this share.
PAYS = 0.75
#: A cache is used if it holds so many of the pixels that no back-reference covers.
CACHED = 1 / 16
#: Bits of one cell of a predictor or cross-colour image: the largest cell there is.
CELL = 9


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of a prefix code for the symbols that occur, none above ``longest``."""
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    some, n = counts[used].astype(np.int64), len(used)
    while True:
        order = np.argsort(some, kind="stable")
        leaf, inner, parent, i, j = some[order].tolist(), [], [0] * (2 * n - 1), 0, 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):  # the two lightest of the unused leaves and inner nodes, both in order
                if j >= len(inner) or (i < n and leaf[i] <= inner[j]):
                    parent[i] = k
                    total += leaf[i]
                    i += 1
                else:
                    parent[n + j] = k
                    total += inner[j]
                    j += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= longest:
            lengths[used[order]] = depth[:n]
            return lengths
        some = (some + 1) // 2 + (int(some.max()) >> longest)  # flatter, and again


REVERSED = np.array([int(f"{i:0{LONGEST}b}"[::-1], 2) for i in range(1 << LONGEST)])


def codes(lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) of every symbol: canonical codes, bits reversed as they are written; owner tells which code a
    length belongs to, in order. A code's lone symbol takes no bits."""
    out, bits = np.zeros(len(lengths), np.int64), lengths.copy()
    used = np.flatnonzero(lengths)
    used = used[np.argsort(owner[used] << 4 | lengths[used], kind="stable")]
    n, of = lengths[used], owner[used]
    units = 1 << (LONGEST - n)
    begin = np.cumsum(units) - units
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(of)))
    out[used] = REVERSED[(begin - np.repeat(begin[first], count)) & ((1 << LONGEST) - 1)]
    bits[used[first[count == 1]]] = 0
    return out, bits


#: How often the code lengths 0 to 11 and the two runs of zeros come about, in small images of text.
_USUAL = {0: 12, 1: 1, 2: 2, 3: 4, 4: 8, 5: 14, 6: 16, 7: 16, 8: 12, 9: 8, 10: 4, 11: 2, 17: 14, 18: 6}
_FIRST = code_lengths(np.array([_USUAL.get(s, 0) for s in range(19)]), LONGEST_FIRST)
_FIRST_CODE, _FIRST_BITS = codes(_FIRST, np.zeros(19, np.int64))
#: The beginning of a description: no simple code, all 19 lengths of the code of code lengths, the whole alphabet.
_OPENING = 15 << 1 | sum(int(_FIRST[s]) << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER))


def _descriptions(lengths: np.ndarray, owner: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, value, bits) pieces that describe n codes, in order; start: where each code's lengths begin."""
    used = np.flatnonzero(lengths)
    count = np.bincount(owner[used], minlength=n)
    lone = np.zeros(n, np.int64)
    lone[owner[used]] = used - start[owner[used]]
    normal = (count > 1) | (lone > 255)
    none, low = count == 0, (count == 1) & (lone < 2)
    every = np.arange(n)
    # one piece for each code, and the symbol of a simple one
    head = np.where(normal, _OPENING, np.where(none, 1, np.where(low, 1 | lone << 3, 5 | lone << 3)))
    head_bits = np.where(normal, 63, np.where(none | low, 4, 11))
    kept = np.flatnonzero(normal[owner])
    value, of = lengths[kept], owner[kept]
    edge = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])) if len(kept) else np.empty(0, np.int64)
    run = np.diff(np.append(edge, len(kept)))
    zero = value[edge] == 0 if len(kept) else np.empty(0, bool)
    at, z = edge[zero], run[zero]
    full, rest = z // 138, z % 138
    some = np.flatnonzero(value)
    last, few, single = rest >= 11, (rest >= 3) & (rest < 11), np.where(rest < 3, rest, 0)
    place = np.concatenate([some, np.repeat(at, full), at[last], at[few], np.repeat(at, single)])
    symbol = np.concatenate(
        [value[some], np.full(int(full.sum()) + int(last.sum()), 18), np.full(int(few.sum()), 17), np.zeros(int(single.sum()), np.int64)]
    )
    extra = np.concatenate(
        [np.zeros(len(some), np.int64), np.full(int(full.sum()), 127), rest[last] - 11, rest[few] - 3, np.zeros(int(single.sum()), np.int64)]
    )
    size = np.zeros(19, np.int64)
    size[[17, 18]] = 3, 7
    order = np.argsort(place, kind="stable")
    place, symbol, extra = place[order], symbol[order], extra[order]
    code = np.concatenate([every, of[place]])
    v = np.concatenate([head, _FIRST_CODE[symbol] | extra << _FIRST_BITS[symbol]])
    b = np.concatenate([head_bits, _FIRST_BITS[symbol] + size[symbol]])
    order = np.argsort(code, kind="stable")
    return code[order], v[order], b[order]


def _put_small(put: list, pixels: np.ndarray) -> None:
    """A transform's own image: literals only."""
    channels = [pixels >> s & 255 for s in (8, 16, 0, 24)]
    sizes = np.array([280, 256, 256, 256, 40])
    start, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(5), sizes)
    lengths = np.concatenate([code_lengths(np.bincount(c, minlength=n)) for c, n in zip([*channels, np.empty(0, np.int64)], sizes, strict=True)])
    _, value, bits = _descriptions(lengths, owner, start, 5)
    put += [(0, 1), *zip(value.tolist(), bits.tolist(), strict=True)]
    code, width = codes(lengths, owner)
    for values in zip(*channels, strict=True):
        put += [(int(code[start[k] + v]), int(width[start[k] + v])) for k, v in enumerate(values)]


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes, which begin at 1."""
    v = v - 1
    high = np.maximum(np.frexp(v.astype(float))[1] - 1, 1)
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + (v >> extra & 1))
    return symbol, v & ((1 << extra) - 1), extra


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.uint8) - b.view(np.uint8)).view(np.uint32)


class _Images:
    """The stored pixels of images, one after another, and the head of each file so far."""

    def __init__(self, images: list[np.ndarray]):
        self.images = images
        self.heads = []
        for p in images:
            head = []
            for v, n in ((0x2F, 8), (p.shape[1] - 1, 14), (p.shape[0] - 1, 14), (1, 1), (0, 3)):
                head.append((v, n))
            self.heads.append(head)
        self.stored = [p.ravel() for p in images]
        self.widths = [p.shape[1] for p in images]

    def laid_out(self):
        size = np.array([len(s) for s in self.stored])
        return np.concatenate(self.stored), np.repeat(np.arange(len(size)), size), np.cumsum(size) - size, size

    def palettes(self) -> np.ndarray:
        """Packs images of 16 colours at most; the others' numbers are left to the other transforms."""
        px, image, _, _ = self.laid_out()
        seen = np.sort(image.astype(np.uint64) << np.uint64(32) | px)
        new = np.concatenate([[True], seen[1:] != seen[:-1]])
        owner = (seen[new] >> np.uint64(32)).astype(np.int64)
        colours = np.bincount(owner, minlength=len(self.stored))
        for k in np.flatnonzero(colours <= 16):
            palette = (seen[new][owner == k] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            bits = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1
            height, width = self.images[k].shape
            index = np.searchsorted(palette, self.stored[k]).reshape(height, width)
            inner = -(-width >> bits)
            index = np.pad(index, ((0, 0), (0, (inner << bits) - width))).reshape(height, inner, 1 << bits)
            packed = (index << (np.arange(1 << bits) * (8 >> bits))).sum(2)
            self.heads[k] += [(1, 1), (3, 2), (len(palette) - 1, 8)]
            _put_small(self.heads[k], _minus(palette, np.concatenate([np.zeros(1, np.uint32), palette[:-1]])).astype(np.int64))
            self.stored[k], self.widths[k] = (packed.ravel() << 8).astype(np.uint32), inner
        return np.flatnonzero(colours > 16)

    def transform(self, among: np.ndarray) -> None:
        """The transform with the least entropy, for those of the images where one pays."""
        if not len(among):
            return
        size = np.array([len(self.stored[k]) for k in among])
        px, image = np.concatenate([self.stored[k] for k in among]), np.repeat(np.arange(len(among)), size)
        begin = (np.cumsum(size) - size)[image]
        width = np.array([self.widths[k] for k in among])[image]
        at = np.arange(len(px))
        local = at - begin
        n = len(among)

        def entropy(p):
            total = np.zeros(n)
            for c in range(4):
                hist = np.bincount(image << 8 | p.view(np.uint8)[c::4], minlength=n << 8).reshape(n, 256)
                total += size * np.log2(size) - (hist * np.log2(np.maximum(hist, 1))).sum(1)
            return total

        above, before = px[np.maximum(at - width, 0)], px[np.maximum(at - 1, 0)]
        edge = np.where(local == 0, np.uint32(0xFF000000), before)
        left = np.where((local >= width) & (local % width == 0), above, edge)
        top = np.where(local < width, edge, above)
        parts = px.view(np.int8).reshape(-1, 4).astype(float)  # blue, green, red, alpha, signed
        total = lambda w: np.bincount(image, w, n)
        factor = lambda c: np.clip(
            np.rint(32 * total(parts[:, 1] * parts[:, c]) / np.maximum(total(parts[:, 1] ** 2), 1)),
            -127,
            127,
        ).astype(np.int64)
        to_red, to_blue = factor(2), factor(0)
        green = parts[:, 1].astype(np.int64)
        red = (px >> 16 & 255).astype(np.int64) - (to_red[image] * green >> 5) & 255
        blue = (px & 255).astype(np.int64) - (to_blue[image] * green >> 5) & 255
        g = px >> 8 & 255
        subtracted = (px & np.uint32(0xFF00FF00)) | ((px >> 16 & 255) - g & 255) << 16 | ((px & 255) - g & 255)
        choices = [px, _minus(px, left), _minus(px, top), ((px & 0xFF00FF00) | red << 16 | blue).astype(np.uint32), subtracted.astype(np.uint32)]
        cost = np.stack([entropy(c) for c in choices])
        best = np.where(cost.min(0) < PAYS * cost[0], cost.argmin(0), 0)
        for j in np.flatnonzero(best):
            k, (height, w) = among[j], self.images[among[j]].shape
            cells = -(-w >> CELL) * -(-height >> CELL)
            head = self.heads[k]
            if best[j] < 3:
                head += [(1, 1), (0, 2), (CELL - 2, 3)]
                _put_small(head, np.full(cells, int(best[j]) << 8))
            elif best[j] == 3:
                head += [(1, 1), (1, 2), (CELL - 2, 3)]
                _put_small(head, np.full(cells, int(to_blue[j] & 255) << 8 | int(to_red[j] & 255)))
            else:
                head += [(1, 1), (2, 2)]
            a = int(begin[np.searchsorted(image, j)])
            self.stored[k] = choices[best[j]][a : a + size[j]]


def _earlier(image: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with the same key in the same image; -1: none."""
    order = np.lexsort((key, image)) if len(key) >= 1 << 24 else None
    if order is None:  # place, key and image sorted as one number
        packed = (image.astype(np.uint64) << np.uint64(52)) ^ (
            key.astype(np.uint64) & np.uint64((1 << 28) - 1)
        ) << np.uint64(24) | np.arange(len(key), dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
        same = packed[1:] >> np.uint64(24) == packed[:-1] >> np.uint64(24)
    else:
        same = (image[order[1:]] == image[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    out = np.full(len(key), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _copies(px: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references that do not overlap, in order.

    Each place looks back to the last place with the same three pixels. Neighbours with one
    distance are a run; a run begins where the runs before it end.
    """
    none = np.empty(0, np.int64)
    if len(px) < SHORTEST + 1:
        return none, none, none
    a, b, c = px[:-2].astype(np.uint64), px[1:-1].astype(np.uint64), px[2:].astype(np.uint64)
    with np.errstate(over="ignore"):
        key = ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD1B54A32D192ED03) + c) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(36)
    back = _earlier(image[:-2], key)
    at = np.arange(len(back))
    ok = (back >= 0) & (image[:-2] == image[2:])
    ok[ok] &= (px[back[ok]] == px[at[ok]]) & (px[back[ok] + 1] == px[at[ok] + 1]) & (px[back[ok] + 2] == px[at[ok] + 2]) & (at[ok] - back[ok] <= FARTHEST)
    far = np.where(ok, at - back, 0)
    edge = np.concatenate([[True], (far[1:] != far[:-1]) | (image[1:-2] != image[:-3])])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(far)]])
    first, last = first[far[first] > 0], last[far[first] > 0] + SHORTEST - 1
    if not len(first):
        return none, none, none
    begin = np.maximum(first, np.concatenate([[0], np.maximum.accumulate(last)[:-1]]))
    n, far = last - begin, far[first]
    keep = n >= SHORTEST
    begin, n, far = begin[keep], n[keep], far[keep]
    pieces = -(-n // FURTHEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, n, far = np.repeat(begin, pieces) + nth * FURTHEST, np.repeat(n, pieces) - nth * FURTHEST, np.repeat(far, pieces)
    return begin, np.minimum(n, FURTHEST), far


def encode_images(images: list[np.ndarray]) -> list[bytes]:
    """A file for each uint32 array of ARGB values (height x width, neither above 2**14)."""
    if not images:
        return []
    if any(max(p.shape) > SIDE or not p.size for p in images):
        raise ValueError("an image is empty or has too many rows or columns")
    held = _Images(images)
    held.transform(held.palettes())
    px, image, begin, size = held.laid_out()
    start, run, far = _copies(px, image)
    literal = np.ones(len(px), bool)
    literal[np.repeat(start, run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)] = False

    # colour cache: of 4 to 10 bits by the image's size
    bits = np.clip(np.frexp(size.astype(float))[1] - 3, 4, 10)
    with np.errstate(over="ignore"):
        key = (px * np.uint32(CACHE_MULTIPLIER)) >> (32 - bits[image]).astype(np.uint32)
    back = _earlier(image, key)
    hit = literal & (back >= 0) & (px[np.maximum(back, 0)] == px)
    bits = np.where(np.bincount(image[hit], minlength=len(size)) > CACHED * np.bincount(image[literal], minlength=len(size)), bits, 0)
    hit &= bits[image] > 0

    copy = np.zeros(len(px), np.int64)
    copy[start] = run
    away = np.zeros(len(px), np.int64)
    away[start] = far
    at = np.flatnonzero(literal | (copy > 0))
    kind = np.where(copy[at] > 0, 2, np.where(hit[at], 1, 0))
    value, owner = px[at].astype(np.int64), image[at]
    n_sym, n_extra, n_bits = _prefix(np.maximum(copy[at], 1))
    d_sym, d_extra, d_bits = _prefix(away[at] + 120)
    green = np.where(kind == 2, 256 + n_sym, np.where(kind == 1, 280 + key[at].astype(np.int64), value >> 8 & 255))

    # the codes of all images one after another: of each image green, red, blue, alpha, distance
    sizes = np.tile(np.array([280, 256, 256, 256, 40]), (len(size), 1))
    sizes[:, 0] += np.where(bits > 0, 1 << bits, 0)
    start = (np.cumsum(sizes) - sizes.ravel()).reshape(-1, 5)
    of = np.repeat(np.arange(sizes.size), sizes.ravel())
    lit, cop = np.flatnonzero(kind == 0), np.flatnonzero(kind == 2)
    begin = start[owner]
    spots = [begin[:, 0] + green, *(begin[lit, c] + (value[lit] >> s & 255) for c, s in ((1, 16), (2, 0), (3, 24))), begin[cop, 4] + d_sym[cop]]
    counts = np.bincount(np.concatenate(spots), minlength=int(sizes.sum()))
    lengths = np.zeros(len(counts), np.int64)
    for a, n in zip(start.ravel().tolist(), sizes.ravel().tolist(), strict=True):
        lengths[a : a + n] = code_lengths(counts[a : a + n])
    for k, head in enumerate(held.heads):
        head += [(0, 1), (1, 1), (int(bits[k]), 4)] if bits[k] else [(0, 1), (0, 1)]
        head.append((0, 1))  # one group of codes
    told, told_value, told_bits = _descriptions(lengths, of, start.ravel(), sizes.size)
    code, width = (x.astype(np.uint64) for x in codes(lengths, of))

    word, wide = code[spots[0]], width[spots[0]]

    def more(rows, v, n):
        word[rows] |= v << wide[rows]
        wide[rows] += n

    for spot in spots[1:4]:
        more(lit, code[spot], width[spot])
    more(cop, n_extra[cop].astype(np.uint64), n_bits[cop].astype(np.uint64))
    more(cop, code[spots[4]], width[spots[4]])
    more(cop, d_extra[cop].astype(np.uint64), d_bits[cop].astype(np.uint64))
    flat = np.array([p for h in held.heads for p in h], np.uint64).reshape(-1, 2)
    of_head = np.repeat(np.arange(len(size)), [len(h) for h in held.heads])
    pieces = [np.concatenate(x) for x in ((of_head, told // 5, owner), (flat[:, 0], told_value.astype(np.uint64), word), (flat[:, 1], told_bits.astype(np.uint64), wide))]
    order = np.argsort(pieces[0], kind="stable")
    return _files(len(size), *(x[order] for x in pieces))


def _files(count: int, owner: np.ndarray, v: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Pieces (value, bits) of the images in order, packed bit by bit, each image from a 64-bit word of its own on."""
    n = n.astype(np.int64)
    run = np.concatenate([[0], np.cumsum(n)])
    first = np.searchsorted(owner, np.arange(count + 1))
    used = run[first[1:]] - run[first[:-1]]
    words = (used + 63) // 64 + 1
    origin = np.cumsum(words) - words
    at = run[:-1] + (origin * 64 - run[first[:-1]])[owner]
    some = n > 0
    v, n, at = v[some], n[some], at[some]
    cell, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out[cell[new]] = np.bitwise_or.reduceat(v << shift, new)
    over = (at & 63) + n > 64
    out[cell[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    raw, files = out.astype("<u8").tobytes(), []
    for o, u in zip((8 * origin).tolist(), ((used + 7) // 8).tolist(), strict=True):
        chunk = b"VP8L" + struct.pack("<I", u) + raw[o : o + u] + b"\0" * (u & 1)
        files.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return files


def dimensions(n: int) -> tuple[int, int]:
    """Width and height for n pixels: 16 wide (64 samples) while the height allows it."""
    width = 16 * max(1, -(-n // (16 * SIDE)))
    if width > SIDE:
        raise ValueError("more samples than an image holds")
    return width, max(1, -(-n // width))


def encode_samples(rows: list[bytes]) -> list[bytes]:
    """A file for each byte string: four samples a pixel in the order alpha, red, green, blue, then zeros."""
    images = []
    for samples in rows:
        width, height = dimensions(-(-len(samples) // 4))
        images.append(np.frombuffer(samples.ljust(4 * width * height, b"\0"), ">u4").astype(np.uint32).reshape(height, width))
    return encode_images(images)
