"""Media columns: lossless WebP files decoded to pixel arrays, and bytes stored as such files."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import table
from .webp_batch import decode_many
from .webp_encode import encode_samples

#: Bytes, and images, taken at one time, unless one image is larger.
CHUNK, IMAGES = 1 << 21, 4_000


def chunked(values: list[bytes | None]):
    """Runs of values of CHUNK bytes and IMAGES values at most, unless one value is larger."""
    held, size = [], 0
    for v in values:
        if held and (size + len(v or b"") > CHUNK or len(held) == IMAGES):
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v or b"")
    if held:
        yield held


def decode_images(df: DataFrame, column: str, into: str = "image") -> DataFrame:
    """df with a struct more: width, height, argb (little-endian uint32 rows, binary), error.

    Null bytes: null fields. Bytes that are no lossless WebP: the reason in error, other fields null.
    """

    @F.pandas_udf("width int, height int, argb binary, error string")
    def decoded(files: pd.Series) -> pd.DataFrame:
        rows = []
        for part in chunked([None if f is None else bytes(f) for f in files]):
            got = iter(decode_many([f for f in part if f is not None]))
            for f in part:
                p = None if f is None else next(got)
                if p is None or isinstance(p, webp.Broken):
                    rows.append((None, None, None, None if p is None else str(p)))
                else:
                    rows.append((p.shape[1], p.shape[0], p.astype("<u4").tobytes(), None))
        return pd.DataFrame(rows, columns=["width", "height", "argb", "error"]).astype({"width": "Int32", "height": "Int32"})

    return df.withColumn(into, decoded(F.col(column)))


def store_bytes(df: DataFrame, column: str, into: str = "media") -> DataFrame:
    """df with a lossless WebP file more that holds the bytes of a binary column (null: none) as 8-bit samples, four a pixel."""

    @F.pandas_udf("binary")
    def encoded(values: pd.Series) -> pd.Series:
        out = []
        for part in chunked([None if v is None else bytes(v) for v in values]):
            made = iter(encode_samples([v for v in part if v is not None]))
            out += [None if v is None else next(made) for v in part]
        return pd.Series(out, dtype=object)

    return df.withColumn(into, encoded(F.col(column)))


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these bytes with zeros up to a positive multiple of 64). Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def feature(samples: np.ndarray) -> str:
    """64 bits in hex: whether each of the 64 columns is brighter than the image."""
    means = samples.reshape(-1, 64).mean(0)
    return np.packbits(means > means.mean()).tobytes().hex()


def text_media(df: DataFrame, column: str = "text", into: str = "media") -> DataFrame:
    """df with a struct more: the text's bytes stored as a lossless WebP file, read back, and digests of both.

    Fields: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, file.
    Equal texts give equal values. A text of more than 2**30 bytes does not fit an image and fails.
    """

    @F.pandas_udf(
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, file binary"
    )
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in chunked([payload(t)[1] for t in texts]):
            files = encode_samples(part)
            for p, file, pixels in zip(part, files, decode_many(files), strict=True):
                if isinstance(pixels, webp.Broken):
                    raise pixels
                raw = pixels.astype(">u4").tobytes()[: len(p)]
                rows.append(
                    (
                        len(raw),
                        hashlib.sha256(raw).hexdigest(),
                        zlib.crc32(raw[-64:]),
                        len(file),
                        hashlib.sha256(file).hexdigest(),
                        feature(np.frombuffer(raw, np.uint8)),
                        file,
                    )
                )
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "file"])
        out.insert(0, "n_bytes", [payload(t)[0] for t in texts])
        return out

    return df.withColumn(into, stored(F.col(column)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media.*").drop("file")
