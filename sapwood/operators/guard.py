"""Limits over node tables, and the counters of a read."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.failures import Limits, PlanFailure, exceeded
from ..functions.paths import display
from .values import own_key


def violations(nodes: DataFrame, limits: Limits, key: str = "doc_id") -> DataFrame:
    """key, fail, at: the first breach of each document that has one, in event order (a key before its value)."""
    never = F.lit(False)
    kind = F.col("kind")
    over = lambda size, bound: (size > bound) if bound is not None else never
    size = F.when(kind == "string", F.octet_length("str")).when(kind == "number", F.coalesce(F.octet_length("lexeme"), F.lit(0))).otherwise(0)
    path = display(F.col("path"))
    fail = (
        F.when(F.coalesce(over(F.octet_length(own_key()), limits.max_key_bytes), never), exceeded("max_key_bytes", limits.max_key_bytes, path))
        .when(kind.isin("object", "array") & over(F.col("depth"), limits.max_depth), exceeded("max_depth", limits.max_depth, path))
        .when(over(size, limits.max_scalar_bytes), exceeded("max_scalar_bytes", limits.max_scalar_bytes, path))
    )
    broken = nodes.select(
        key,
        F.coalesce("pre", F.lit(-1).cast("long")).alias("at"),
        F.coalesce("fail", fail).alias("fail"),
    ).where("fail is not null")
    return broken.groupBy(key).agg(F.min_by("fail", "at").alias("fail"), F.min("at").alias("at"))


def guarded(nodes: DataFrame, limits: Limits, key: str = "doc_id", strict: bool = False) -> DataFrame:
    """nodes up to each document's first breach; strict: a breach fails the query with its code."""
    first = violations(nodes, limits, key).withColumnRenamed(key, "_k")
    out = nodes.join(
        first.select("_k", F.col("at").alias("_at"), F.col("fail.code").alias("_code"), F.col("fail.message").alias("_message")),
        F.col(key) == F.col("_k"),
        "left",
    )
    if strict:
        return out.where(
            F.when(F.col("_at").isNotNull(), F.raise_error(F.concat_ws(": ", "_code", "_message")).cast("boolean")).otherwise(True)
        ).drop("_k", "_at", "_code", "_message")
    return out.where("_at is null or pre < _at").drop("_k", "_at", "_code", "_message")


def metrics(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, events, keys, scalars of each document."""
    container = F.col("kind").isin("object", "array").cast("long")
    member = own_key().isNotNull().cast("long")
    root = (F.size("path") == 0).cast("long")
    return nodes.where("pre is not null").groupBy(key).agg(
        F.sum(1 + container + member + root).alias("events"),
        F.sum(member).alias("keys"),
        F.sum(1 - container).alias("scalars"),
    )


@contextmanager
def abortable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag; if abort(spark, tag) ends them, the failure is ABORTED."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield
    except Exception as e:
        if tag in str(e) and "cancel" in str(e).lower():
            raise PlanFailure("ABORTED", f"the jobs of {tag} were ended") from e
        raise
    finally:
        context.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    """Ends all running jobs that carry the tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
