"""What several training-data operators share: tables, scratch tables, numpy text hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A table of at most this many rows may be broadcast once its rows have been counted.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder of this machine serves in
    local mode; on a cluster that would lose tables without a word, so there it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(spark: SparkSession, df: DataFrame, path: str, batch_rows: int | None = None) -> DataFrame:
    """df written once as Parquet and read again: its lineage ends there, so a lost executor costs no
    recomputation of what came before. batch_rows: rows that a Python worker gets at one time, if not Spark's own number."""
    settings = {_CLEANUP: "true"}  # the written table stands for its shuffles, so their files can go
    if batch_rows:
        settings[_BATCH_ROWS] = str(batch_rows)
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """df written to a table of its own in the shared folder."""
    return written(spark, df, f"{scratch_dir(spark).rstrip('/')}/sapwood/{what}-{uuid.uuid4().hex}", batch_rows)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    # a table without rows has no files to name it; its folder stays
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it was counted to be small; otherwise as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_MUL, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One odd-looking 64-bit value for each byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _MUL) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class RangeHash:
    """Polynomial hashes modulo 2**64 of any ranges of one value array, after one running sum."""

    _pow, _inv = powers(1 << 16), powers(1 << 16, _INV)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if n + 1 > len(RangeHash._pow):
            size = 1 << (n + 1).bit_length()
            RangeHash._pow, RangeHash._inv = powers(size), powers(size, _INV)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * RangeHash._pow[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * RangeHash._inv[start])
