"""Many lossless WebP images decoded at once in numpy.

Heads (transforms, cache size, prefix codes) are read image by image. The pixel codes of all images
are parted into stretches of bits that are all decoded at the same time, step by step, each from a
guessed start; a stretch begins where the one before it ends, and is decoded again until that has
settled, which is soon since prefix codes fall into step. What comes out are literals, cache codes
and back-references. Cache codes and back-references are pointers to earlier pixels (the nearest
one before with the same cache place, the one a distance away), followed by pointer doubling.
"""

from __future__ import annotations

import numpy as np

from .webp import CACHE_MULTIPLIER, LENGTH_ORDER, NEAR, Bits, Broken, decode, payload_of, read_header, read_transforms, undo_transforms

#: Bits of a stretch that is decoded on its own.
STRETCH = 1024
#: Longest code that a table is made for; images with longer ones are decoded one by one.
LONGEST = 12
_REVERSED = [np.array([int(f"0{i:b}".zfill(n)[-n:][::-1] or "0", 2) if n else 0 for i in range(1 << n)]) for n in range(LONGEST + 1)]
_NEAR = np.array(NEAR)


class _Slow(Exception):
    """An image that the one-by-one decoder must read."""


class _Head:
    """One image's sizes and transforms; its prefix codes are read with those of others."""

    def __init__(self, file: bytes):
        bits = Bits(payload_of(file) + b"\0" * 8)
        bits.end -= 64
        self.width, self.height = read_header(bits)
        self.undo, self.inner = read_transforms(bits, self.width, self.height)
        self.cache = bits.read(4) if bits.read(1) else 0
        if self.cache > 11:
            raise Broken("colour cache too large")
        if bits.read(1):  # several groups of codes: which one depends on the place
            raise _Slow
        self.bits, self.count, self.error = bits, self.inner * self.height, None


_TABLES: dict[tuple[int, ...], np.ndarray] = {}


def _first_table(lengths: tuple[int, ...]) -> np.ndarray:
    """symbol | length << 5 for each value of seven bits, of a code of code lengths."""
    if (found := _TABLES.get(lengths)) is None:
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise Broken("a code without symbols")
        if len(used) == 1:
            found = np.full(128, used[0], np.int64)
        else:
            order = np.array(sorted(used, key=lambda s: (lengths[s], s)))
            n = np.array(lengths)[order]
            if (1 << (7 - n)).sum() != 128:
                raise Broken("a code that is not complete")
            found = np.repeat(order | n << 5, 1 << (7 - n))[_REVERSED[7]]
        if len(_TABLES) > 4096:
            _TABLES.clear()
        _TABLES[lengths] = found
    return found


def _window(heads: list[_Head]):
    """The bits of all images as one string, and where each image's begin."""
    sizes = [len(h.bits.data) for h in heads]
    raw = np.frombuffer(b"".join(h.bits.data for h in heads) + b"\0" * 8, np.uint8).astype(np.uint32)
    window = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    top = len(window) - 1

    def look(pos):
        return window[np.minimum(pos >> 3, top)] >> (pos & 7).astype(np.uint32)

    return look, 8 * (np.cumsum(sizes) - sizes)


def _begin_code(bits: Bits, alphabet: int):
    """A simple code's symbols, or (table of the code of code lengths, code lengths that follow at most)."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        if max(symbols) >= alphabet:
            raise Broken("a symbol outside the alphabet")
        return symbols, None, 0
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    return None, _first_table(tuple(first)), left


def _read_codes(heads: list[_Head], look, origin: np.ndarray) -> list[np.ndarray]:
    """The code lengths of the five codes of all images: rows of a matrix for each kind of code. The codes of one kind
    are read at the same time, one code length of each image at a step."""
    out = []
    for kind in range(5):
        alphabets = np.array([(280 + (1 << h.cache if h.cache else 0), 256, 256, 256, 40)[kind] for h in heads])
        lengths = np.zeros((len(heads), int(alphabets.max())), np.int8)
        rows, tables, left = [], [], []
        for k, h in enumerate(heads):
            if h.error is None:
                try:
                    symbols, table, n = _begin_code(h.bits, int(alphabets[k]))
                except (Broken, IndexError) as e:
                    h.error = e if isinstance(e, Broken) else Broken(str(e))
                    continue
                if symbols is not None:
                    lengths[k, symbols] = 1
                else:
                    rows.append(k)
                    tables.append(table)
                    left.append(n)
        if not rows:
            out.append(lengths)
            continue
        row, table, left = np.array(rows), np.concatenate(tables), np.array(left)
        base = 128 * np.arange(len(row))
        pos = origin[row] + np.array([heads[k].bits.at for k in rows])
        end = origin[row] + np.array([heads[k].bits.end for k in rows])
        at, before, size = np.zeros(len(row), np.int64), np.full(len(row), 8), alphabets[row]
        live = np.arange(len(row))
        while len(live):
            window = look(pos[live])
            e = table[base[live] + (window & np.uint32(127))]
            symbol, used = e & 31, e >> 5
            plain = symbol < 16
            some = live[plain]
            lengths[row[some], at[some]] = symbol[plain]
            some = live[plain & (symbol > 0)]
            before[some] = symbol[plain & (symbol > 0)]
            window = (window >> used.astype(np.uint32)).astype(np.int64)
            times = np.where(plain, 1, np.where(symbol == 16, 3 + (window & 3), np.where(symbol == 17, 3 + (window & 7), 11 + (window & 127))))
            for i in np.flatnonzero(symbol == 16):
                j = live[i]
                lengths[row[j], at[j] : min(at[j] + times[i], size[j])] = before[j]
            pos[live] += used + np.where(plain, 0, np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7)))
            at[live] += times
            left[live] -= 1
            live = live[(at[live] < size[live]) & (left[live] > 0) & (pos[live] <= end[live])]
        for j, k in enumerate(rows):
            heads[k].bits.at = int(pos[j] - origin[k])
            if at[j] > size[j] or pos[j] > end[j]:
                heads[k].error = Broken("code lengths run over" if at[j] > size[j] else "the bits end early")
        out.append(lengths)
    return out


def _code_tables(heads: list[_Head], lengths: list[np.ndarray]):
    """(table, base, mask): for kind c and image k the entries base[c, k] .. base[c, k] + mask[c, k] of table, each
    symbol | length << 12 for a value of the next bits. Images with codes that are not complete, or too long, get an error."""
    tables, base, mask, filled = [], np.zeros((5, len(heads)), np.int64), np.zeros((5, len(heads)), np.uint32), 0
    for c, rows in enumerate(lengths):
        owner, symbol = np.nonzero(rows)
        n = rows[owner, symbol].astype(np.int64)
        count = np.bincount(owner, minlength=len(heads))
        most = np.zeros(len(heads), np.int64)
        np.maximum.at(most, owner, n)
        most[count == 1] = 0
        units = np.bincount(owner, 2.0 ** -n, minlength=len(heads))
        for k in np.flatnonzero((count == 0) | ((count > 1) & (units != 1)) | (most > LONGEST)):
            if heads[k].error is None:
                heads[k].error = Broken(
                    "a code without symbols" if not count[k] else "a code that is not complete"
                ) if most[k] <= LONGEST or units[k] != 1 else _Slow()
        good = np.array([h.error is None for h in heads])
        keep = good[owner]
        owner, symbol, n = owner[keep], symbol[keep], n[keep]
        n = np.where(count[owner] == 1, 0, n)
        order = np.argsort(owner << 4 | n, kind="stable")
        owner, symbol, n = owner[order], symbol[order], n[order]
        size = np.where(good, 1 << most, 0)
        begin = np.cumsum(size) - size
        plain = np.repeat(symbol | n << 12, 1 << (most[owner] - n)).astype(np.int32)
        table = np.empty_like(plain)
        for bits in np.unique(most[good]):
            which = np.flatnonzero(good & (most == bits))
            at = begin[which][:, None]
            table[at + np.arange(1 << bits)] = plain[at + _REVERSED[bits][None, :]]
        base[c], mask[c] = filled + begin, (1 << most) - 1
        filled += len(table)
        tables.append(table)
    return np.concatenate(tables), base, mask


def decode_many(files: list[bytes]) -> list[np.ndarray | Broken]:
    """The ARGB values (uint32, height x width) of every file, or why it has none."""
    out: list = [None] * len(files)

    def alone(i):
        try:
            return decode(files[i])
        except (Broken, IndexError) as e:
            return e if isinstance(e, Broken) else Broken(str(e))

    heads = []
    for i, f in enumerate(files):
        try:
            heads.append((i, _Head(f)))
        except _Slow:
            out[i] = alone(i)
        except (Broken, IndexError) as e:
            out[i] = e if isinstance(e, Broken) else Broken(str(e))
    if heads:
        for (i, head), stored in zip(heads, _pixels([h for _, h in heads]), strict=True):
            out[i] = alone(i) if isinstance(stored, _Slow) else stored if isinstance(stored, Broken) else _finished(head, stored)
    return out


def _finished(head: _Head, stored: np.ndarray) -> np.ndarray:
    return undo_transforms(stored, head.height, head.undo).reshape(head.height, head.width)


def _tokens(heads: list[_Head], look, origin: np.ndarray, table: np.ndarray, base: np.ndarray, mask: np.ndarray):
    """(image, value, length, distance) of all pixel codes in order. Literals: length 0, distance 0, the
    value; cache codes: length 0, distance -1, the cache place; back-references: both above 0."""
    starts, ends, image = [], [], []
    for k, h in enumerate(heads):
        cut = np.arange(h.bits.at, max(h.bits.end, h.bits.at + 1), STRETCH) + origin[k]
        starts.append(cut)
        ends.append(np.append(cut[1:], origin[k] + h.bits.end))
        image.append(np.full(len(cut), k))
    first = np.concatenate([[0], np.cumsum([len(s) for s in starts])[:-1]])
    start, end, image = np.concatenate(starts), np.concatenate(ends), np.concatenate(image)
    widths = np.array([h.inner for h in heads])

    leave, settled = start.copy(), np.zeros(len(start), np.int64)
    leads = np.zeros(len(start), bool)
    leads[first] = True
    enter, todo, turn, found = start.copy(), np.arange(len(start)), 0, []
    while len(todo):
        turn += 1
        settled[todo] = turn
        live, pos = todo, enter[todo]
        leave[todo] = pos
        going = pos < end[live]
        live, pos = live[going], pos[going]
        img, stop = image[live], end[live]
        step = 0
        while len(live):
            e = table[base[0][img] + (look(pos) & mask[0][img])]
            symbol = e & 0xFFF
            pos = pos + (e >> 12)
            value, length, far = symbol.astype(np.int64), np.zeros(len(live), np.int32), np.zeros(len(live), np.int32)
            kind = symbol >= 256
            some = np.flatnonzero(~kind)
            if len(some):
                p, g, v = pos[some], img[some], value[some] << 8
                for c, shift in ((1, 16), (2, 0), (3, 24)):
                    e = table[base[c][g] + (look(p) & mask[c][g])].astype(np.int64)
                    v |= (e & 0xFFF) << shift
                    p = p + (e >> 12)
                pos[some], value[some] = p, v
            if len(some) < len(live):
                far[symbol >= 280] = -1
                value[symbol >= 280] -= 280
                some = np.flatnonzero(kind & (symbol < 280))
                if len(some):
                    p, g = pos[some], img[some]
                    n, p = _number(symbol[some] - 256, p, look)
                    e = table[base[4][g] + (look(p) & mask[4][g])]
                    code, p = _number(e & 0xFFF, p + (e >> 12), look)
                    near = _NEAR[np.minimum(code, 120) - 1]
                    back = np.where(code > 120, code - 120, np.maximum(near[:, 0] + near[:, 1] * widths[g], 1))
                    length[some], far[some], pos[some] = n, back, p
            found.append((live, np.full(len(live), turn, np.int32), np.full(len(live), step, np.int32), value, length, far))
            step += 1
            going = pos < stop
            if not going.all():
                leave[live[~going]] = pos[~going]
                live, pos, img, stop = live[going], pos[going], img[going], stop[going]
        should = np.where(leads, start, np.concatenate([[0], leave[:-1]]))
        todo = np.flatnonzero(should != enter)
        enter = should
    lane, made, step, value, length, far = (np.concatenate([f[i] for f in found]) for i in range(6))
    keep = np.flatnonzero(settled[lane] == made)
    keep = keep[np.argsort(lane[keep].astype(np.int64) << 32 | step[keep])]
    return image[lane[keep]], value[keep], length[keep], far[keep]


def _number(symbol: np.ndarray, pos: np.ndarray, look) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes, and the place behind their extra bits."""
    symbol = symbol.astype(np.int64)
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    got = look(pos).astype(np.int64) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + got) + 1, pos + extra


def _pixels(heads: list[_Head]) -> list[np.ndarray | Broken | _Slow]:
    """The stored pixels of every image."""
    look, origin = _window(heads)
    table, base, mask = _code_tables(heads, _read_codes(heads, look, origin))
    out: list = [h.error for h in heads]
    some = []
    for k, h in enumerate(heads):
        if out[k] is None:
            if mask[:4, k].any():
                some.append(k)
                continue
            # codes of one symbol each take no bits: one colour, or what only the one-by-one decoder reads
            green, red, blue, alpha = (int(table[base[c, k]]) & 0xFFF for c in range(4))
            out[k] = _Slow() if green >= 256 else np.full(h.count, alpha << 24 | red << 16 | green << 8 | blue, np.int64)
    if some:
        which = np.array(some)
        for k, got in zip(
            some,
            _resolved([heads[k] for k in some], *_tokens([heads[k] for k in some], look, origin[which], table, base[:, which], mask[:, which])),
            strict=True,
        ):
            out[k] = got
    return out


def _resolved(heads: list[_Head], image: np.ndarray, value: np.ndarray, length: np.ndarray, far: np.ndarray) -> list[np.ndarray | Broken]:
    """The stored pixels of images from their pixel codes."""
    count = np.array([h.count for h in heads])
    first = np.searchsorted(image, np.arange(len(heads) + 1))
    take = np.maximum(length, 1).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(take)])
    local = run[:-1] - run[first[image]]
    keep = local < count[image]
    missing = run[first[1:]] - run[first[:-1]] < count
    begin = np.cumsum(count) - count
    image, value, far, take, local = image[keep], value[keep], far[keep].astype(np.int64), take[keep], local[keep]
    bad = np.zeros(len(heads), bool)
    bad[image[(far > local) | (local + take > count[image])]] = True
    bad |= missing
    total = int(count.sum())
    good = ~bad[image]
    image, value, far, take, local = image[good], value[good], far[good], take[good], local[good]
    at = begin[image] + local
    pixel, source = np.zeros(total + 1, np.int64), np.arange(total + 1)
    lit = far == 0
    pixel[at[lit]] = value[lit]
    cop = np.flatnonzero(far > 0)
    n = take[cop]
    inside = np.repeat(at[cop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    source[inside] = inside - np.repeat(far[cop], n)
    cached = far == -1
    if cached.any():
        root = _followed(source, inside)
        place, bits = np.full(total + 1, -1), np.array([h.cache for h in heads])
        shift = np.repeat(32 - bits, count)
        where = np.flatnonzero(np.repeat(bits > 0, count))
        place[where] = (pixel[where] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift[where]
        place[at[cached]] = value[cached]
        place[inside] = place[root[inside]]
        owner = np.repeat(np.arange(len(heads)), count)[where]
        order = where[np.argsort((owner << 11 | place[where]), kind="stable")]
        same = np.concatenate(
            [
                [False],
                (place[order[1:]] == place[order[:-1]]) & (np.searchsorted(begin, order[1:], "right") == np.searchsorted(begin, order[:-1], "right")),
            ]
        )
        before = np.full(total + 1, total)  # an unused place of the cache holds 0
        before[order[same]] = order[np.flatnonzero(same) - 1]
        source[at[cached]] = before[at[cached]]
        inside = np.concatenate([inside, at[cached]])
    pixel = pixel[_followed(source, inside)]
    return [Broken("the bits end early" if missing[k] else "a back-reference outside the image") if bad[k] else pixel[begin[k] : begin[k] + count[k]] for k in range(len(heads))]


def _followed(source: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where each place's pointers end; only those in some point away from themselves."""
    root = source.copy()
    while len(some):
        ahead = root[root[some]]
        moved = ahead != root[some]
        root[some] = ahead
        some = some[moved]
    return root
