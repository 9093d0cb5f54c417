"""Packing documents into sequences along a space-filling curve.

A document's token counts are hashed into a short vector, projected to a few dimensions and given
its Hilbert key. Documents are range-partitioned and sorted by (key, id), so neighbours on the
curve are neighbours in a partition, and are cut into full sequences one after another. What is
left at a partition's end is cut into sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, stored, table
from .tokens import chunked, tokenizer

SEQUENCE = 4096
END_ID = 2
#: Hashed vector length, projected dimensions, bits of each on the curve.
BUCKETS, DIMS, BITS = 256, 4, 15
#: Tokens of one partition of the curve aimed at.
PARTITION_TOKENS = 4_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with unsigned coordinates below 2**bits (Skilling's transform)."""
    x = x.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            set_ = (x[:, i] & np.uint64(q)) != 0
            swap = np.where(set_, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(set_, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents from their ids."""
    rng = np.random.default_rng(5)
    h = mix(ids.astype(np.uint64))
    bucket, sign = (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    owner = np.repeat(np.arange(len(counts)), counts)
    v = np.bincount(owner * BUCKETS + bucket, sign, len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ rng.standard_normal((BUCKETS, DIMS))
    u = 1 / (1 + np.exp(-1.702 * z))  # about uniform
    return hilbert_key(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(_id, n, curve, ids): little-endian ids of two bytes (four if the vocabulary needs them), the end id included."""
    docs = docs.select(F.col(key).alias("_id"), "text")

    def run(batches):
        bpe = tokenizer(path)
        kind = np.dtype("<u2" if bpe.size <= 1 << 16 else "<u4")
        for batch in batches:
            first = 0
            for texts in chunked(batch.column("text")):
                ids, counts = bpe.encode(texts)
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, END_ID), counts + 1
                curve, ends = curve_keys(ids, counts), np.cumsum(counts)
                raw = ids.astype(kind)
                blobs = [raw[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(first, len(texts)), pa.array(counts), pa.array(curve), pa.array(blobs, pa.binary())],
                    ["_id", "n", "curve", "ids"],
                )
                first += len(texts)

    return docs.mapInArrow(run, f"_id {dict(docs.dtypes)['_id']}, n long, curve long, ids binary")


def cuts(total: int, last: bool, sequence: int = SEQUENCE) -> np.ndarray:
    """Ends of sequences in a run of so many tokens; the rest below one sequence is cut only at the last call."""
    full = np.arange(1, total // sequence + 1) * sequence
    rest = total % sequence
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if last and rest else []
    return np.concatenate([full, total - rest + np.cumsum(tail, dtype=np.int64)]).astype(np.int64)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, key: str = "doc_id", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Null or blank text: the end id alone. Rows that repeat a key are packed each; their pieces carry
    the same key. Any text length: a document is cut wherever a sequence ends. Empty table: empty
    result. sequence_id is unique, not gapless. Only the key and ``text`` are read.
    """
    path = path or default_tokenizer()
    rows = stored(spark, tokenized(docs, path, key), "packing-tokens")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PARTITION_TOKENS))
    ordered = rows.repartitionByRange(parts, "curve", "_id").sortWithinPartitions("curve", "_id")
    wide = tokenizer(path).size > 1 << 16

    def run(batches):
        base, number = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []  # (id, start, ids, tokens of its document): below one sequence

        def emit(last: bool):
            nonlocal held, number
            sizes = np.array([len(h[2]) for h in held], np.int64)
            ends = np.cumsum(sizes)
            at = cuts(int(ends[-1]), last, sequence) if len(held) else np.empty(0, np.int64)
            if not len(at):
                return None
            ids = np.concatenate([h[2] for h in held])
            till = at[-1]
            marks = np.unique(np.concatenate([[0], ends[ends <= till], at]))
            a, b = marks[:-1], marks[1:]
            doc, seq = np.searchsorted(ends, a, side="right"), np.searchsorted(at, a, side="right")
            begun = ends[doc] - sizes[doc]
            start = a - begun + np.array([h[1] for h in held], np.int64)[doc]
            offset = a - np.concatenate([[0], at])[seq]
            out = pd.DataFrame(
                {
                    "_id": [held[i][0] for i in doc],
                    "start": start,
                    "length": b - a,
                    "doc_tokens": [held[i][3] for i in doc],
                    "sequence_id": base + number + seq,
                    "offset": offset,
                    "ids": [ids[x:y].tobytes() for x, y in zip(a, b, strict=True)],
                }
            )
            number += len(at)
            left = int(np.searchsorted(ends, till, side="right"))
            rest = held[left:]
            if rest and till > ends[left] - sizes[left]:
                gone = int(till - (ends[left] - sizes[left]))
                i, s, x, n = rest[0]
                rest[0] = (i, s + gone, x[gone:], n)
            held = rest
            return out

        for p in batches:
            for i, n, blob in zip(p["_id"], p["n"], p["ids"], strict=True):
                held.append((i, 0, np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4"), n))
            if (out := emit(False)) is not None:
                yield out
        if (out := emit(True)) is not None:
            yield out

    id_type = dict(rows.dtypes)["_id"]
    packed = ordered.select("_id", "n", "ids").mapInPandas(
        run,
        f"_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )
    return packed.withColumnRenamed("_id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark, table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
