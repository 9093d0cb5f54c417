"""Secret scans: a worklist that unwraps nested layers of a text and scans each of them.

The text itself is layer 0. From every layer, percent escapes, Unicode and character escapes,
base64 runs (line-wrapped or glued ones too) and packed bytes inside them are undone into further layers until none is new
(a text already seen at the same place ends a cycle; at another place it is scanned again). Every character of a layer knows the span of the original text
that it comes from, so what a scan finds there is reported as a span of the original text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import itertools
import lzma
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base patterns and the least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_ALL = 8, 16
#: Bytes of one unpacked layer held at once. A larger one is read in pieces, up to RATIO times its
#: packed bytes; what grows beyond both is a bomb, and is not opened any further.
LAYER_BYTES, RATIO = 1 << 24, 100
#: Bytes unpacked in one step, and bytes that two pieces of a large layer share.
STEP, SHARED = 1 << 16, 1 << 12
#: Least bytes of text taken out of other bytes. No base pattern is shorter.
STRETCH = 14

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>]*")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)+={{0,2}}")
_PACKED = re.compile(r"H4sI|Qlpo|/Td6WF|(?<=[+/])e[AFJN]")
_STRETCH = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){%d,}+" % STRETCH)
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\{}&#;> \t\r\n"
_STANDARD = str.maketrans("-_", "+/")
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the three base patterns in one text: kind, start, end (exclusive)."""
    low, found = text.lower(), []
    if any(word in low for word in ("password", "passwd", "secret", "token", "api")):
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_ALL]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _bytes_to_layer(data: bytes, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]] | None:
    """UTF-8 bytes with a span for each, as characters with a span for each; None if they are no text."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if sum(c.isprintable() or c in "\r\n\t" for c in text) < 0.95 * len(text):
        return None
    if len(text) == len(data) or spans is _SAME:
        return text, spans
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        out.append((spans[at][0], spans[at + n - 1][1]))
        at += n
    return text, out


class _Same:
    """The spans of a layer below a packed run: each character comes from the whole run."""

    def __getitem__(self, at):
        return (0, 0)


_SAME = _Same()


def _opener(head: bytes):
    """A new decompressor for gzip, zlib, bzip2 or xz bytes that begin so; None if they are none."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 27)
    return None


def _inflated(chunks):
    """(n, bytes) in steps for the members of packed bytes, one after another; what follows the last is n = -1.

    Broken or torn members give what could be read before the break."""
    chunks, data = iter(chunks), b""
    for n in itertools.count():
        while len(data) < 6 and (more := next(chunks, b"")):
            data += more
        if (opened := _opener(data)) is None:
            break
        try:
            while not opened.eof:
                got = opened.decompress(data, STEP)
                data = getattr(opened, "unconsumed_tail", b"")
                if got:
                    yield n, got
                elif not data and not (data := next(chunks, b"")):
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        data = opened.unused_data.lstrip(b"\0")
    for more in itertools.chain([data], chunks):
        if more:
            yield -1, more


def _texts(data: bytes):
    """What bytes hold: themselves if they are packed, one text, or the stretches of text in them."""
    if _opener(data):
        yield data
    elif got := _bytes_to_layer(data, _SAME):
        yield got[0]
    else:
        for m in _STRETCH.finditer(data):
            if got := _bytes_to_layer(m[0], _SAME):
                yield got[0]


def _plain(chunks, depth: int = 32):
    """A stream of bytes with all packing around it undone."""
    chunks, head = iter(chunks), b""
    while len(head) < 6 and (more := next(chunks, b"")):
        head += more
    chunks = itertools.chain([head], chunks)
    if depth and _opener(head):
        chunks = _plain((piece for _, piece in _inflated(chunks)), depth - 1)
    yield from chunks


def _large(chunks, most: int):
    """The texts of a layer too large to be held: pieces cut outside runs where that can be, each with the end of the last."""
    held, check, read = bytearray(), LAYER_BYTES, 0
    for piece in _plain(chunks):
        held += piece
        read += len(piece)
        if len(held) >= check:
            cut = len(held.rstrip(_RUN_BYTES))
            if cut <= SHARED and check == LAYER_BYTES:
                check *= 2
                continue
            cut = cut if cut > SHARED else len(held)
            yield from _texts(bytes(held[:cut]))
            held, check = held[cut - SHARED :], LAYER_BYTES
        if read > most:
            return
    yield from _texts(bytes(held))


def _unpack(data: bytes):
    """The layers directly inside packed bytes: all members joined, and each of several; bytes where they are packed again."""
    most, size, parts = RATIO * len(data), 0, []
    pieces = _inflated([data])
    for n, piece in pieces:
        parts.append((n, piece))
        size += len(piece)
        if size > LAYER_BYTES:
            if size <= most:
                yield from _large((p for _, p in itertools.chain(parts, pieces)), most)
            return
    members = [b"".join(p for _, p in group) for _, group in itertools.groupby(parts, lambda p: p[0])]
    if not members or parts[0][0] < 0:  # they only look packed
        if got := _bytes_to_layer(data, _SAME):
            yield got[0]
        return
    yield from _texts(b"".join(p for n, p in parts if n >= 0))
    if len(members) > 1:
        for member in members:
            yield from _texts(member)


def _digest(layer) -> bytes:
    return hashlib.blake2b(layer if isinstance(layer, bytes) else b"\0" + layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _kinds_inside(data: bytes) -> tuple[set[str], set[bytes]]:
    """The kinds found in all layers below packed bytes, and the digests of their texts; only one path of layers is held."""
    kinds, done, texts, work = set(), set(), set(), [iter([data])]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif (mark := _digest(layer)) not in done:
            done.add(mark)
            if isinstance(layer, bytes):
                work.append(_unpack(layer))
            else:
                texts.add(mark)
                kinds.update(k for k, _, _ in base_spans(layer))
                work.append(below for below, _ in layers(layer, _SAME))
    return kinds, texts


def _escaped(found: re.Match) -> list[tuple[str, int, int]]:
    """The characters of one escape run, each with the place of its own escape."""
    run, at = found[0], found.start()
    if run.startswith("&#"):
        return [(html.unescape(run), at, found.end())]
    if run.startswith(("\\u{", "\\U")):
        code = int(run[3:-1] if run[2] == "{" else run[2:], 16)
        return [(chr(code), at, found.end())] if code < 0x110000 and not 0xD800 <= code < 0xE000 else []
    out: list[tuple[str, int, int]] = []
    for m in _UNIT.finditer(run):
        code = int(m[1] or m[2], 16)
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high = out.pop()
            out.append((chr(0x10000 + ((ord(high[0]) - 0xD800) << 10) + code - 0xDC00), high[1], at + m.end()))
        else:
            out.append((chr(code), at + m.start(), at + m.end()))
    return [(c, a, b) for c, a, b in out if not 0xD800 <= ord(c) < 0xE000]


def _substituted(text: str, spans, pattern: re.Pattern, undo) -> tuple[str, list] | None:
    """The whole layer with each run of escapes replaced by its characters; the rest keeps its spans."""
    parts, where, last = [], [], 0
    at = (lambda i: (i, i + 1)) if spans is None else spans.__getitem__
    for m in pattern.finditer(text):
        chars = undo(m)
        if not chars:
            continue
        parts.append(text[last : m.start()])
        parts.extend(c for c, _, _ in chars)
        if spans is not _SAME:
            where.extend(map(at, range(last, m.start())))
            for c, a, b in chars:
                where.extend([(at(a)[0], at(b - 1)[1])] * len(c))
        last = m.end()
    if not last:
        return None
    if spans is _SAME:
        return "".join([*parts, text[last:]]), spans
    where.extend(map(at, range(last, len(text))))
    return "".join([*parts, text[last:]]), where


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    data = bytes.fromhex(m[0].replace("%", ""))
    got = _bytes_to_layer(data, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(data))])
    return [(c, *s) for c, s in zip(*got, strict=True)] if got else []


def _unbase64(run: str) -> bytes:
    if len(run) % 4 == 1:
        run = run[:-1]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _runs(text: str):
    """(places, characters) of base64: every unbroken run, and the lines of wrapped ones joined."""
    found = False
    for m in _BASE64.finditer(text):
        found = True
        yield range(m.start(), m.end()), m[0]
    if not found:
        return
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()
        for gap in _BREAK.finditer(text, m.start(), m.end()):
            lines.append(range(at, gap.start()))
            at = gap.end()
        lines.append(range(at, m.end()))
        first = 0
        while first + 1 < len(lines):  # a first line of any length, lines of one length, a shorter last one
            end = first + 1
            while end < len(lines) and len(lines[end]) == len(lines[first + 1]):
                end += 1
            if end < len(lines) and len(lines[end]) < len(lines[end - 1]):
                end += 1
            block = lines[first:end]
            yield [i for line in block for i in line], "".join(text[line.start : line.stop] for line in block)
            first = end - 1


def layers(text: str, spans=None):
    """The layers directly below one layer, as (text, span of the original for each character) or (packed bytes, their span)."""
    if "%" in text and (got := _substituted(text, spans, _PERCENT, _percent)):
        yield got
    if ("\\" in text or "&#" in text) and (got := _substituted(text, spans, _ESCAPE, _escaped)):
        yield got
    for places, run in _runs(text):

        def span(a: int, b: int) -> tuple[int, int]:
            return (places[a], places[b] + 1) if spans is None else (spans[places[a]][0], spans[places[b]][1])  # noqa: B023

        def each(at: int, start: int, end: int):
            return spans if spans is _SAME else [span(at + i // 3 * 4 + i % 3, at + i // 3 * 4 + i % 3 + 1) for i in range(start, end)]  # noqa: B023

        last = len(run) - 1
        run = run.rstrip("=").translate(_STANDARD)
        data = _unbase64(run)
        if _opener(data):
            yield data, span(0, last)
        if got := _bytes_to_layer(data, each(0, 0, len(data)) if data.isascii() else _SAME if spans is _SAME else [span(0, last)] * len(data)):
            yield got
            continue
        # something else is glued to the run: packed bytes that begin inside it, and text at any of the four alignments
        for m in _PACKED.finditer(run, 1):
            if next(_inflated([_unbase64(run[m.start() : m.start() + 256])]), (-1,))[0] >= 0:
                yield _unbase64(run[m.start() :]), span(m.start(), last)
        for at in range(4):
            for m in _STRETCH.finditer(data if not at else _unbase64(run[at:])):
                if got := _bytes_to_layer(m[0], each(at, *m.span())):
                    yield got


def find(text: str | None) -> tuple[list[Span], list[Span], int]:
    """(base spans, all spans, distinct texts seen). Spans are sorted by start, then kind as listed, then end; each once.

    A text is scanned once for each place of the original that it comes from. Where a part of that
    place gives the same text already (an encoded run that goes on after an escape), the whole place counts.
    """
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found, done, work, packed = {text: [(0, len(text), base)]}, set(), [(text, None)], {}
    while work:
        layer, spans = work.pop()
        for below, where in layers(layer, spans):
            if isinstance(below, bytes):
                packed.setdefault(below, []).append(where)
            elif below and (place := (below, tuple(where))) not in done:
                done.add(place)
                inside = [(k, where[a][0], where[b - 1][1]) for k, a, b in base_spans(below)]
                found.setdefault(below, []).append((where[0][0], where[-1][1], inside))
                work.append((below, where))
    every = set(base)
    for of_text in found.values():
        reach = low = -1
        for start, end, spans in sorted(of_text, key=lambda f: (f[0], -f[1])):
            if end > reach or (start, end) == (low, reach):
                low, reach = start, end
                every.update(spans)
    texts, torn = set(), {}  # a torn run begins where the whole one does
    for data, runs in packed.items():
        kinds, inside = _kinds_inside(data)
        texts |= inside
        for k, (start, end) in itertools.product(kinds, runs):
            torn[k, start] = max(end, torn.get((k, start), end))
    every.update((k, start, end) for (k, start), end in torn.items())
    return base, sorted(every, key=order), len(texts.union(map(_digest, found))) if texts else len(found)


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with one struct column more: n_assign, n_access, n_hex, base_sha256, spans, layers.

    Null text: as an empty one, with no spans. Other columns stay as they are, repeated rows too.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every, n = find(t)
            kinds = [k for k, _, _ in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(every), n))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers"])

    return docs.withColumn(into, scanned(F.col(text)))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of ``text`` replaced by a mark (overlapping spans by one); null stays null."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            last, parts = 0, []
            for _, a, b in find(t)[1] if t else ():
                if a >= last:
                    parts += [t[last:a], mark]
                last = max(last, b)
            out.append("".join([*parts, t[last:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", redacted(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")
