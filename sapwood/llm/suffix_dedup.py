"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Only suffixes that begin at anchors (see anchors.py) are indexed; each 200-byte string holds one,
at a place that its own bytes decide. A suffix array is a table of suffix classes, sorted by
(fingerprint of the anchor's gram, fingerprint of its whole context): the WINDOW - 1 bytes before
the anchor and the 200 from it on, which hold every 200-byte string that has this anchor. The order
is that of fingerprints, not of bytes: it brings equal suffixes together, which is all that a match
needs, and a row stays 24 bytes long.

A batch of documents gets such an array, which is merge-scanned against every level of the index.
The scan gives the batch's matches, in the batch itself and with all batches before it, and
the levels that have the batch's size become one level of twice the size in the same pass. An index
is a folder of tables and can be opened again for later batches.

A class met twice is a long match: all its context goes. Classes that share only the gram may
still share a 200-byte string near the edge of a passage; one context of each is then fetched and
their 200-byte strings are compared by fingerprint, small groups within a task, large ones as
rows that are pre-aggregated. Fingerprints have 64 bits, within a gram's group of 64 bits; a row is
named by a 64-bit hash of its key and text.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, WINDOW, anchors
from .common import BYTE_VALUES, RangeHash, drop_stored, mix, scratch_dir, stored, table, written

#: Batches that one table is added in: the second merges with the first, the third is scanned against the level of both.
BATCHES = 3
#: Classes of one gram that a task compares itself.
GROUP = 2048
#: Rows of compared contexts that a task takes, about.
TASK_ROWS = 500
#: Rows that a Python worker holds at one time.
ROWS = 1_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _suffixes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram fingerprint, context fingerprint) of every anchor of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    hasher = RangeHash(BYTE_VALUES[data])
    at = anchors(hasher, 0, len(data))
    low, high = np.maximum(at - (WINDOW - 1), 0), np.minimum(at + LENGTH, len(data))
    with np.errstate(over="ignore"):
        context = mix(hasher.of(low, high) + (at - low).astype(np.uint64) * _A + (high - at).astype(np.uint64) * _B)
    return at, hasher.of(at, at + GRAM), context


def _suffix_array(docs: DataFrame) -> DataFrame:
    """(gram, context, n), one row per class, summed within each batch of rows and then overall."""

    def run(batches):
        for p in batches:
            found = [_suffixes(t)[1:] for t in p["text"]]
            pair = np.concatenate([np.stack(f, 1) for f in found]) if found else np.empty((0, 2), np.uint64)
            if len(pair):
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[order]
                first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)]))
                yield pd.DataFrame(
                    {"gram": pair[first, 0].astype(np.int64), "context": pair[first, 1].astype(np.int64), "n": np.diff(np.append(first, len(pair)))}
                )

    return docs.select("text").mapInPandas(run, "gram long, context long, n long").groupBy("gram", "context").agg(F.sum("n").alias("n")).sortWithinPartitions("gram", "context")


class SuffixIndex:
    """Levels of suffix arrays; level k holds 2**k batches, at most one array each.

    folder: where the arrays and the list of levels are kept; an index found there goes on. None: a new
    folder in the shared one. An array is (gram, context, n): how often a class occurs in its level.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{scratch_dir(spark).rstrip('/')}/sapwood/suffix-index-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.levels = 0, {}
        if folder and self._exists():
            held = spark.read.schema("level int, path string, v int").parquet(f"{self.folder}/levels").collect()
            self.version = max(r["v"] for r in held)
            self.levels = {r["level"]: r["path"] for r in held if r["v"] == self.version and r["level"] >= 0}

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/levels")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _array(self, path: str) -> DataFrame:
        return self.spark.read.schema("gram long, context long, n long").parquet(path)

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes a batch in; gives its matches: (gram, context, long, size), all classes, old and new, whose
        gram the batch holds and that the index or the batch holds elsewhere too. long: the class itself
        occurs twice or more; size: classes of this gram."""
        new = stored(self.spark, _suffix_array(docs), "suffix-batch", ROWS)
        level = 0
        while level in self.levels:
            level += 1
        zero = F.lit(0).cast("long")
        parts = [new.select("gram", "context", F.col("n").alias("new"), F.col("n").alias("own"), zero.alias("rest"))]
        for at, path in self.levels.items():
            n = F.col("n")
            parts.append(
                self._array(path).select(
                    "gram",
                    "context",
                    zero.alias("new"),
                    (n if at < level else zero).alias("own"),
                    (zero if at < level else n).alias("rest"),
                )
            )
        path = f"{self.folder}/array-{level}-{uuid.uuid4().hex}"
        if len(parts) == 1:
            scan = parts[0]
            written(self.spark, new, path)
        else:
            both = parts[0]
            for p in parts[1:]:
                both = both.unionByName(p)
            scan = both.groupBy("gram", "context").agg(*[F.sum(c).alias(c) for c in ("new", "own", "rest")]).sortWithinPartitions("gram", "context")
            scan = stored(self.spark, scan, "suffix-scan")
            written(self.spark, scan.where("own > 0").select("gram", "context", F.col("own").alias("n")), path)
        n = F.col("own") + F.col("rest")
        grams = scan.groupBy(F.col("gram").alias("g")).agg(
            F.sum("new").alias("mine"),
            F.sum(n).alias("total"),
            F.count("*").alias("size"),
        ).where("mine > 0 and total > 1").select("g", "size")
        grams = stored(self.spark, grams, "suffix-grams")
        met = scan.join(grams, F.col("gram") == F.col("g")).where((n > 1) | (F.col("size") > 1)).select(
            "gram",
            "context",
            (n > 1).alias("long"),
            "size",
        )
        met = stored(self.spark, met, "suffix-met")
        drop_stored(self.spark, grams)
        drop_stored(self.spark, new)
        if len(parts) > 1:
            drop_stored(self.spark, scan)
        merged = [p for at, p in self.levels.items() if at < level]
        self.levels = {at: p for at, p in self.levels.items() if at > level} | {level: path}
        self.version += 1
        listed = self.spark.createDataFrame(list(self.levels.items()), "level int, path string").coalesce(1)
        written(self.spark, listed, f"{self.folder}/levels/v={self.version}")  # from here on the batch is in
        for p in merged:
            drop_stored(self.spark, self._array(p))
        return met


def _window_matrix(p: pd.DataFrame) -> np.ndarray:
    """Fingerprints of each row's 200-byte strings by their distance 0 .. WINDOW-1 before the anchor; 0: none there."""
    sizes = p["bytes"].map(len).to_numpy()
    hasher = RangeHash(BYTE_VALUES[np.frombuffer(b"".join(p["bytes"]), np.uint8)])
    begin = np.cumsum(sizes) - sizes
    left, r = p["left"].to_numpy(), np.arange(WINDOW)
    start = (begin + left)[:, None] - r
    there = (r <= left[:, None]) & (start + LENGTH <= (begin + sizes)[:, None])
    start = np.where(there, start, 0)
    with np.errstate(over="ignore"):
        got = mix(hasher.of(start.ravel(), start.ravel() + LENGTH).reshape(start.shape) + p["gram"].to_numpy().astype(np.uint64)[:, None] * _A)
    return np.where(there, got | np.uint64(1), np.uint64(0))


def _edges(p: pd.DataFrame) -> pd.DataFrame:
    """(r, at, nearest, farthest): the least and greatest distance at which a row's string is another row's too."""
    w = _window_matrix(p)
    order = np.argsort(w, axis=0)
    s = np.take_along_axis(w, order, 0)
    same = (s[1:] == s[:-1]) & (s[1:] != 0)
    dup = np.zeros(w.shape, bool)
    dup[1:] |= same
    dup[:-1] |= same
    hit = np.zeros(w.shape, bool)
    np.put_along_axis(hit, order, dup, 0)
    rows = np.flatnonzero(hit.any(1))
    return pd.DataFrame(
        {
            "r": p["r"].to_numpy()[rows],
            "at": p["at"].to_numpy()[rows],
            "nearest": hit[rows].argmax(1),
            "farthest": WINDOW - 1 - hit[rows][:, ::-1].argmax(1),
        }
    )


def repeated_spans(spark: SparkSession, docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(r, spans array<struct<a,b>>) for rows r of docs (r, text): byte ranges that repeated strings cover, not yet merged or clipped."""
    index = SuffixIndex(spark)
    matches = [index.add(docs.where(F.pmod("r", F.lit(batches)) == b)) for b in range(batches)]
    for path in index.levels.values():
        drop_stored(spark, index._array(path))
    met = matches[0]
    for m in matches[1:]:
        met = met.unionByName(m)
    # what a later batch says of a class holds: it has seen more
    met = met.groupBy(F.col("gram").alias("g"), F.col("context").alias("c")).agg(F.max("long").alias("long"), F.max("size").alias("size"))
    # stored, so that the join with all entries has plain exchanges and adaptive execution can split a hot class
    met = stored(spark, met, "suffix-met")
    return spans_of(spark, docs, met, [*matches, met])


def spans_of(spark: SparkSession, docs: DataFrame, met: DataFrame, scratch: list[DataFrame] = ()) -> DataFrame:
    """repeated_spans for matches met (g, c, long, size) of an index that holds docs."""

    def entries(parts):
        for p in parts:
            found = [_suffixes(t) for t in p["text"]]
            yield pd.DataFrame(
                {
                    "r": np.repeat(p["r"].to_numpy(), [len(f[0]) for f in found]),
                    "at": np.concatenate([f[0] for f in found]),
                    "gram": np.concatenate([f[1] for f in found]).astype(np.int64),
                    "context": np.concatenate([f[2] for f in found]).astype(np.int64),
                }
            ) if len(p) else p[["r"]].assign(at=0, gram=0, context=0)

    found = docs.mapInPandas(entries, "r long, at long, gram long, context long").join(
        met,
        (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")),
    ).select("r", "at", "gram", "context", "long", "size")
    found = stored(spark, found, "suffix-found", ROWS)
    for m in scratch:
        drop_stored(spark, m)

    # one context of each class whose gram has other classes
    one = found.where("size > 1").groupBy("gram", "context").agg(
        F.min(F.struct("r", "at")).alias("low"),
        F.first("long").alias("long"),
        F.first("size").alias("size"),
    )
    wanted = one.select(
        F.col("low.r").alias("w"),
        F.struct(F.col("low.at").alias("at"), "gram", "long", "size").alias("e"),
    ).groupBy("w").agg(F.collect_list("e").alias("wanted"))
    fetched = docs.join(wanted, F.col("r") == F.col("w")).select("r", "text", "wanted")

    def contexts(parts):
        for p in parts:
            rows = []
            for r, text, wanted in zip(p["r"], p["text"], p["wanted"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for e in wanted:
                    low = max(e["at"] - (WINDOW - 1), 0)
                    rows.append((r, e["at"], e["gram"], e["long"], e["size"], e["at"] - low, data[low : e["at"] + LENGTH]))
            yield pd.DataFrame(rows, columns=["r", "at", "gram", "long", "size", "left", "bytes"])

    shape = "r long, at long, gram long, long boolean, size long, left long, bytes binary"
    held = stored(spark, fetched.mapInPandas(contexts, shape).dropDuplicates(["r", "at"]), "suffix-contexts", ROWS)
    small, large = held.where(F.col("size") <= GROUP), held.where(F.col("size") > GROUP)
    tasks = max(1, small.count() // TASK_ROWS)
    edges = small.groupBy(
        F.pmod(F.xxhash64("gram"), F.lit(tasks)).alias("task")
    ).applyInPandas(_edges, "r long, at long, nearest long, farthest long")

    def strings(parts):
        for p in parts:
            if len(p):
                w = _window_matrix(p)
                row, far = np.nonzero(w)
                yield pd.DataFrame({"s": w[row, far].astype(np.int64), "r": p["r"].to_numpy()[row], "at": p["at"].to_numpy()[row], "far": far})

    rows = stored(spark, large.mapInPandas(strings, "s long, r long, at long, far long"), "suffix-strings", ROWS)
    twice = stored(
        spark,
        rows.groupBy(F.col("s").alias("k"), F.col("far").alias("f")).agg(F.count("*").alias("n")).where("n > 1").select("k", "f"),
        "suffix-twice",
    )
    far_edges = rows.join(
        twice,
        (F.col("s") == F.col("k")) & (F.col("far") == F.col("f")),
        "left_semi",
    ).groupBy("r", "at").agg(F.min("far").alias("nearest"), F.max("far").alias("farthest"))
    partial = edges.unionByName(far_edges).select(
        "r",
        (F.col("at") - F.col("farthest")).alias("a"),
        (F.col("at") - F.col("nearest") + LENGTH).alias("b"),
    )
    full = found.where("long").select("r", (F.col("at") - (WINDOW - 1)).alias("a"), (F.col("at") + LENGTH).alias("b")).distinct()
    spans = full.unionByName(partial).groupBy("r").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stored(spark, spans, "suffix-spans")
    for t in (found, held, rows, twice):
        drop_stored(spark, t)
    return spans


def cut(spark: SparkSession, docs: DataFrame, key: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    A null text counts as empty. Texts below 200 bytes keep all. Rows that repeat a key and a text
    are copies of each other, like any two rows with one text. Any text length: a document's
    anchors are one task's work. Other columns are not read. Empty table: empty result.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col("text"), F.xxhash64(F.col(key).cast("string"), "text").alias("r"))
    spans = repeated_spans(spark, rows.select("r", "text"), batches).withColumnRenamed("r", "s_r")

    def keep(parts):
        for p in (whole.iloc[a : a + ROWS] for whole in parts for a in range(0, len(whole), ROWS)):
            out = []
            for text, spans in zip(p["text"], p["spans"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                last, n, kept = 0, 0, []
                end = -1
                for s in sorted((max(s["a"], 0), min(s["b"], len(data))) for s in (spans if spans is not None else ())):
                    if s[0] > end:
                        kept.append(data[last : s[0]])
                        n += 1
                        last = end = s[1]
                    elif s[1] > end:
                        last = end = s[1]
                kept = b"".join([*kept, data[last:]])
                out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(_id=p["_id"].to_numpy())

    joined = rows.join(spans, F.col("r") == F.col("s_r"), "left").select("_id", "text", "spans")
    return joined.mapInPandas(
        keep,
        f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, _id {dict(rows.dtypes)['_id']}",
    ).select(F.col("_id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(spark, table(spark, sf_dir, "documents")).drop("kept")
