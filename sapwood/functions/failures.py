"""Failure codes, limits and the shape of a failure."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes, in their order of declaration.
CODES = [
    "DSL_PARSE_ERROR", "DSL_TYPE_ERROR", "STREAM_REUSED", "STREAMABILITY_UNKNOWN", "INPUT_ORDER_VIOLATION", "CAPTURE_OVERLAP_UNSUPPORTED", "MISSING_VALUE", "DUPLICATE_MEMBER",
    "INVALID_NUMBER", "PROTOCOL_ORDER_ERROR", "TARGET_VALUE_UNREPRESENTABLE", "RESOURCE_LIMIT_EXCEEDED", "INPUT_INVALID", "OUTPUT_FAILED", "ABORTED",
]

#: Bytes that a retained value costs for each node, and for a number without source text.
NODE_BYTES, NUMBER_BYTES = 16, 8

FAIL_TYPE = "struct<code: string, message: string, path: string, limit: string, bound: bigint, row: int, col: int>"


class PlanFailure(ValueError):
    """A failure that is known before any row is read."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Limits:
    """Named bounds. None: unlimited."""

    max_depth: int | None = 256
    max_key_bytes: int | None = 64 << 10
    max_scalar_bytes: int | None = 16 << 20
    max_metadata_bytes: int | None = 16 << 20
    max_columns: int | None = 10_000
    max_record_bytes: int | None = 64 << 20
    max_capture_bytes: int | None = 64 << 20
    max_output_bytes: int | None = None

    @classmethod
    def unlimited(cls) -> Limits:
        return cls(**{f.name: None for f in fields(cls)})


def failure(code: str, message: str, path: Column | None = None, limit: str | None = None, bound: int | None = None) -> Column:
    if code not in CODES:
        raise ValueError(code)
    null = F.lit(None)
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(message).alias("message"),
        (null.cast("string") if path is None else path).alias("path"),
        F.lit(limit).cast("string").alias("limit"),
        F.lit(bound).cast("bigint").alias("bound"),
        null.cast("int").alias("row"),
        null.cast("int").alias("col"),
    )


def exceeded(name: str, bound: int, path: Column | None = None) -> Column:
    return failure("RESOURCE_LIMIT_EXCEEDED", f"more than {name}", path, name, bound)


def to_text(fail: dict) -> str:
    """A failure as compact JSON, absent parts left out."""
    return json.dumps({k: v for k, v in fail.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))
