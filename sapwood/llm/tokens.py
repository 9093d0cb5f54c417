"""Token ids of many texts at once, equal to a word-end BPE tokenizer's own.

A text is parted at ASCII white space, which such a tokenizer drops and never joins across, and
every distinct part of a chunk is tokenized once. Parts of ASCII and Latin-1 letters, digits and
marks go through a vectorised form of the merge list: in every piece the pair of lowest rank is
merged, over all pieces at a time. All other parts go to the tokenizer itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text tokenized at one time, unless one text is larger.
CHUNK = 1 << 23
NONE = np.int32(2**31 - 1)


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairRanks:
    """Rank of a pair of ids by a few hash tables, each holding what collided in the one before."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.tables, bits = [], 19
        while len(keys):
            slot = self._slot(keys, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            k, r = np.zeros(1 << bits, np.uint64), np.full(1 << bits, NONE, np.int32)
            k[slot[first]], r[slot[first]] = keys[first] + np.uint64(1), ranks[first]
            self.tables.append((bits, k, r))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks, bits = keys[left], ranks[left], max(bits - 2, 8)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15 + 2 * n * 0x1234567)) >> np.uint64(64 - bits)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        out, open_ = np.full(len(keys), NONE, np.int32), None
        for n, (bits, k, r) in enumerate(self.tables):
            at = self._slot(keys, bits, n)
            hit = k[at] == keys + np.uint64(1)
            if open_ is None:
                out[hit] = r[at[hit]]
                open_ = np.flatnonzero(~hit & (k[at] != 0))  # an empty slot: no such pair in later tables either
            else:
                out[open_[hit]] = r[at[hit]]
                open_ = open_[~hit & (k[at] != 0)]
            if not len(open_):
                break
            keys = (a[open_].astype(np.uint64) << np.uint64(20)) | b[open_].astype(np.uint64)
        return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        alphabet = _byte_alphabet()
        self.inner = np.array([vocab.get(c, 0) for c in alphabet], np.int32)
        self.final = np.array([vocab.get(c + end, 0) for c in alphabet], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = PairRanks((left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64), np.arange(len(pairs), dtype=np.int32))
        self.size = max(vocab.values()) + 1

    def _bpe(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) for pieces of bytes that begin at starts."""
        piece = np.zeros(len(data), np.int32)
        piece[starts[1:]] = 1
        piece = np.cumsum(piece, dtype=np.int32)
        last = np.ones(len(data), bool)
        last[:-1] = piece[1:] != piece[:-1]
        sym = np.where(last, self.final[data], self.inner[data])
        done_sym, done_piece = [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            open_ = np.flatnonzero(~last)
            if len(open_):
                rank[open_] = self.ranks.of(sym[open_], sym[open_ + 1])
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            active = np.repeat(low < NONE, length)
            if not active.all():
                done_sym.append(sym[~active])
                done_piece.append(piece[~active])
            pick = active & (rank == np.repeat(low, length))
            # of overlapping equal pairs, the first, third, ... merge
            at = np.flatnonzero(pick)
            if len(at) > 1:
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            sym[at] = self.merged[rank[at]]
            last[at] = last[at + 1] if len(at) else last[at]
            keep = active
            keep[at + 1] = False
            sym, piece, last = sym[keep], piece[keep], last[keep]
        ids, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=len(starts))

    def parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) for an array of distinct parts without white space."""
        n = len(words)
        counts = np.zeros(n, np.int64)
        if not n:
            return np.empty(0, np.int32), counts
        buffers, off = words.buffers(), words.offset
        offsets = np.frombuffer(buffers[1], np.int32)[off : off + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]].copy() if buffers[2] is not None else np.empty(0, np.uint8)
        offsets -= offsets[0]
        prev = np.concatenate([[0], data[:-1]]).astype(np.uint8) if len(data) else data
        follows = prev == 0xC3
        fine = _PLAIN[data] | (data == 0xC3) | (follows & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7))
        bad_before = np.concatenate([[0], np.cumsum(~fine)])
        safe = bad_before[offsets[1:]] == bad_before[offsets[:-1]]
        out_ids, owner = [], []
        if safe.any():
            byte_word = np.repeat(np.arange(n), np.diff(offsets))
            keep = safe[byte_word]
            d, w, f = data[keep], byte_word[keep], follows[keep]
            lower = d + np.where((d >= 65) & (d <= 90), 32, 0).astype(np.uint8) + np.where(f & (d >= 0x80) & (d <= 0x9E), 32, 0).astype(np.uint8)
            kind = np.where(_DIGIT[d], 1, np.where(_LETTER[d] | (d >= 0x80), 0, 2))
            new = np.ones(len(d), bool)
            new[1:] = (w[1:] != w[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1)
            starts = np.flatnonzero(new)
            ids, per = self._bpe(lower, starts)
            out_ids.append(ids)
            owner.append(np.repeat(w[starts], per))
        rest = np.flatnonzero(~safe)
        if len(rest):
            for i, e in zip(rest, self.slow.encode_batch(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
                out_ids.append(np.array(e.ids, np.int32))
                owner.append(np.full(len(e.ids), i))
        ids, owner = np.concatenate(out_ids), np.concatenate(owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = split.flatten().dictionary_encode()
        ids, counts = self.parts(flat.dictionary)
        at = flat.indices.to_numpy(zero_copy_only=False)
        n = counts[at]
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1][at]
        till = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(begin - till[:-1], n) + np.arange(till[-1])]
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        return out, np.diff(till[ends])


#: ASCII bytes that the vectorised form takes: no control characters, apostrophe (contractions) or '<' (special tokens).
_PLAIN = np.array([33 <= b < 127 and chr(b) not in "'<" for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])


@lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def chunked(texts: pa.Array):
    """Slices of about CHUNK bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, s in enumerate(sizes):
        held += s
        if held >= CHUNK:
            yield texts.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < len(texts):
        yield texts.slice(first)
