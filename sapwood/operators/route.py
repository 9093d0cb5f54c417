"""Captures: tagged scopes of documents, whole or as paths only, in completion order.

All captures of a route come from one pass over the node table: a node belongs to a capture if the
capture's steps fit the beginning of its path, and the scope's root is then the node's ancestor at
that depth. No join is needed; a capture's text and size are sums over its nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.failures import FAIL_TYPE, Limits, PlanFailure, exceeded, failure
from ..functions.paths import Selector, display
from .values import fragments, joined, node_bytes


@dataclass(frozen=True)
class Capture:
    tag: str
    select: Selector
    mode: str = "materialize"
    budget: int | None = None
    budget_name: str = "max_capture_bytes"


def checked(specs: list[Capture]) -> list[Capture]:
    for i, a in enumerate(specs):
        for b in specs[:i]:
            if "materialize" in (a.mode, b.mode) and a.select.may_overlap(b.select):
                raise PlanFailure("CAPTURE_OVERLAP_UNSUPPORTED", f"{b.tag} {b.select} and {a.tag} {a.select} may overlap")
    return specs


def route(nodes: DataFrame, specs: list[Capture], limits: Limits = Limits(), key: str = "doc_id", refuse: Column | None = None) -> DataFrame:
    """key, ord, capture_id, tag, path, begin, end, kind, value, bytes, fail.

    ord counts a document's captures from 0 as they complete; of captures of one scope the one
    declared later comes first. value is compact JSON text, null for observed scopes. A scope above
    its byte budget has fail and no value. No specs, or no match: no rows.

    refuse is a condition on tag, path (as text), begin and kind. The first scope of a document for which it holds
    is refused as it begins: it is the document's last row, with fail ABORTED at its path; scopes that had not
    completed by then are gone.
    """
    specs = checked(specs)
    if not specs:
        specs = [Capture("", Selector.of("\0none"), "observe")]
    held = []
    for i, s in enumerate(specs):
        fits = s.select.covers(F.col("path")) if s.mode == "materialize" else s.select.selects(F.col("path"))
        held.append(F.when(fits, F.struct(F.lit(i).alias("id"), F.get("ancestors", F.lit(len(s.select.steps))).alias("root"))))
    part = nodes.where("pre is not null").withColumn("_c", F.explode(F.array_compact(F.array(*held)))).withColumn("_root", F.col("_c.root"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("capture_id") + 1)
    is_root = F.col("pre") == F.col("_root")
    whole = F.element_at(F.array(*[F.lit(s.mode == "materialize") for s in specs]), F.col("_c.id") + 1)
    got = part.groupBy(key, F.col("_c.id").alias("capture_id"), F.col("_root").alias("begin")).agg(
        F.max("last").alias("end"),
        F.max(F.when(is_root, F.struct("path", "kind", "depth"))).alias("_at"),
        F.sum(node_bytes(is_root)).alias("bytes"),
        joined(F.collect_list(F.when(whole, fragments(is_root)))).alias("value"),
    )
    materialized = pick([s.mode == "materialize" for s in specs])
    budgets = [s.budget if s.budget is not None else limits.max_capture_bytes for s in specs]
    fail = F.lit(None)
    for i, (s, b) in enumerate(zip(specs, budgets, strict=True)):
        if s.mode == "materialize" and b is not None:
            fail = F.when((F.col("capture_id") == i) & (F.col("bytes") > b), exceeded(s.budget_name, b, display(F.col("_at.path")))).otherwise(fail)
    if refuse is not None:
        seen = F.struct("begin", "capture_id")
        named = got.select(
            key,
            "capture_id",
            "begin",
            pick([s.tag for s in specs]).alias("tag"),
            display(F.col("_at.path")).alias("path"),
            F.col("_at.kind").alias("kind"),
        )
        first = named.where(refuse).groupBy(F.col(key).alias("_k")).agg(F.min(seen).alias("_no"))
        got = got.join(first, F.col(key) == F.col("_k"), "left").where(
            F.col("_no").isNull() | (F.col("end") < F.col("_no.begin")) | (seen == F.col("_no"))
        )
        refused = F.col("_no").isNotNull() & (seen == F.col("_no"))
        fail = F.when(refused, failure("ABORTED", "the scope is refused", display(F.col("_at.path"))).cast(FAIL_TYPE)).otherwise(fail.cast(FAIL_TYPE))
        # a refused scope ends the document, whatever is inside it
        got = got.withColumn("end", F.when(refused, F.lit(1 << 62)).otherwise(F.col("end")))
    order = Window.partitionBy(key).orderBy("end", F.desc(F.size("_at.path")), F.desc("capture_id"))
    out = got.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).withColumn("fail", fail)
    good = materialized & F.col("fail").isNull()
    return out.select(
        key,
        "ord",
        "capture_id",
        pick([s.tag for s in specs]).alias("tag"),
        display(F.col("_at.path")).alias("path"),
        "begin",
        "end",
        F.col("_at.kind").alias("kind"),
        F.when(good, F.col("value")).alias("value"),
        F.when(materialized, F.col("bytes")).alias("bytes"),
        "fail",
    )


def metrics(captures: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, captures, captured_bytes, captured_bytes_high: what a document's captures retained, together and the largest of them."""
    held = F.coalesce("bytes", F.lit(0))
    return captures.groupBy(key).agg(F.count("*").alias("captures"), F.sum(held).alias("captured_bytes"), F.max(held).alias("captured_bytes_high"))


def duplicates_inside(nodes_all: DataFrame, spec: Capture, key: str = "doc_id") -> DataFrame:
    """key, path, code of captures that hold a repeated member, from a node table read with duplicates='all'."""
    k = len(spec.select.steps)
    part = nodes_all.where("pre is not null").where(spec.select.covers(F.col("path"))).withColumn("root", F.get("ancestors", F.lit(k)))
    inner = part.where(F.size("path") > k).where(F.try_element_at("path", F.lit(-1))["key"].isNotNull())
    twice = inner.groupBy(
        key,
        "root",
        F.try_element_at("ancestors", F.lit(-2)).alias("parent"),
        F.try_element_at("path", F.lit(-1))["key"].alias("name"),
        F.slice("path", 1, k).alias("path") if k else F.array().cast("array<struct<key: string, idx: int>>").alias("path"),
    ).count().where("count > 1")
    return twice.select(key, display(F.col("path")).alias("path"), F.lit("DUPLICATE_MEMBER").alias("code")).distinct()
