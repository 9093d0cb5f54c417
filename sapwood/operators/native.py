"""JSON documents without Python: selectors as Variant expressions.

For results in which neither a number's text nor the order of members nor repeated members show: a
Variant keeps members by name, so rows that come before the metadata are not told from rows after
it. A second root value in one text is not noticed here either. The node table notices both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.failures import FAIL_TYPE, Limits, PlanFailure, exceeded, failure
from ..functions.paths import Selector
from .table import TableColumn


def _quote(name: str) -> str | None:
    """A member name as a step of a Variant path; None: no path can say it."""
    for mark in ("'", '"'):
        if name and mark not in name:
            return f"[{mark}{name}{mark}]"
    return None


def json_path(steps) -> str | None:
    """A Variant path for plain steps; None where a name is empty or has both kinds of quotes."""
    if any(isinstance(s, tuple) for s in steps):
        raise PlanFailure("DSL_TYPE_ERROR", "an each-step has no single path")
    parts = [f"[{s}]" if isinstance(s, int) else _quote(s) for s in steps]
    return None if None in parts else "$" + "".join(parts)


def value_at(variant: Column, steps, kind: str) -> Column:
    """The value at plain steps; names that no path can say are looked up as members."""
    said: list = []
    for s in steps:
        if isinstance(s, str) and _quote(s) is None:
            inner = F.try_variant_get(variant, json_path(said), "map<string,variant>")
            variant, said = F.try_element_at(inner, F.lit(s)), []
        else:
            said.append(s)
    return F.try_variant_get(variant, json_path(said), kind)


def each(docs: DataFrame, selector: Selector, content: str = "content", into: str = "value") -> DataFrame:
    """docs with one row per selected scope: idx and name of the last each-step, and its value as a Variant."""
    df = docs.withColumn(into, F.try_parse_json(F.col(content)))
    before: list = []
    df = df.withColumn("idx", F.lit(None).cast("int")).withColumn("name", F.lit(None).cast("string"))
    for s in selector.steps:
        if not isinstance(s, tuple):
            before.append(s)
            continue
        if before:
            df = df.withColumn(into, value_at(F.col(into), before, "variant"))
            before = []
        kept = [c for c in df.columns if c not in (into, "idx", "name")]
        if s[1] == "index":
            parts = F.try_variant_get(F.col(into), "$", "array<variant>")
            df = df.select(*kept, F.posexplode(parts).alias("idx", into)).withColumn("name", F.lit(None).cast("string"))
        else:
            parts = F.map_entries(F.try_variant_get(F.col(into), "$", "map<string,variant>"))
            df = df.select(*kept, F.explode(parts).alias("_e")).select(
                *kept,
                F.col("_e.value").alias(into),
                F.lit(None).cast("int").alias("idx"),
                F.col("_e.key").alias("name"),
            )
    return df.withColumn(into, value_at(F.col(into), before, "variant")) if before else df


def native_table(docs: DataFrame, rows: Selector, columns: list[tuple[TableColumn, str]], content: str = "content") -> DataFrame:
    """One row per selected row scope with one typed column per (column, type); what is absent or of another kind is NULL."""
    keep = [c for c in docs.columns if c != content]
    found = each(docs, rows, content, "_row")
    return found.select(*keep, F.col("idx").alias("row_no"), *[value_at(F.col("_row"), c.source, kind).alias(c.label) for c, kind in columns])


def described(docs: DataFrame, meta: Selector, limits: Limits = Limits(), content: str = "content", key: str = "doc_id") -> DataFrame:
    """key, v (the document), columns array<struct<label, steps, path>>, fail: the columns that each document
    describes itself, an array of {"title": text, "path": [names and numbers from 0]}.

    steps are struct<name, idx>. path is the steps as a Variant path, null where none can say them.
    INPUT_INVALID: a text that cannot be read, metadata that is absent or no array, a column without
    title or path. More than max_columns: RESOURCE_LIMIT_EXCEEDED.
    """
    at = F.lit(str(meta))
    parsed = docs.select(key, F.try_parse_json(F.col(content)).alias("v")).withColumn("_m", value_at(F.col("v"), meta.steps, "variant"))
    found = parsed.withColumn("_d", F.try_variant_get("_m", "$", "array<variant>"))
    kind = lambda v: F.schema_of_variant(v)
    whole = lambda v: F.try_variant_get(v, "$", "bigint")
    is_text = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    is_index = lambda v: F.coalesce(
        ~kind(v).isin("STRING", "BOOLEAN") & (whole(v) >= 0) & (whole(v) == F.try_variant_get(v, "$", "double")),
        F.lit(False),
    )
    step = lambda v: F.struct(
        F.when(is_text(v), F.try_variant_get(v, "$", "string")).alias("name"),
        F.when(is_index(v), whole(v)).cast("int").alias("idx"),
    )
    each_ = F.transform(
        "_d",
        lambda c: F.struct(F.try_variant_get(c, "$.title", "variant").alias("title"), F.try_variant_get(c, "$.path", "array<variant>").alias("path")),
    )
    found = found.withColumn("_c", each_)
    good = lambda c: is_text(c["title"]) & c["path"].isNotNull() & F.forall(
        F.coalesce(c["path"], F.array()),
        lambda s: s.isNotNull() & (is_text(s) | is_index(s)),
    )
    bad = F.array_position(F.transform("_c", lambda c: F.coalesce(good(c), F.lit(False))), F.lit(False))
    found = found.withColumn("_bad", bad)
    columns = F.transform(
        "_c",
        lambda c: F.struct(F.try_variant_get(c["title"], "$", "string").alias("label"), F.transform(c["path"], step).alias("steps")),
    )
    found = found.withColumn("_s", columns)
    quoted = lambda n: F.when(
        ~n.contains("'") & (n != ""),
        F.concat(F.lit("['"), n, F.lit("']")),
    ).when(~n.contains('"') & (n != ""), F.concat(F.lit('["'), n, F.lit('"]')))
    one = lambda s: F.when(s["idx"].isNotNull(), F.concat(F.lit("["), s["idx"].cast("string"), F.lit("]"))).otherwise(quoted(s["name"]))
    path = lambda c: F.concat(F.lit("$"), F.aggregate(F.transform(c["steps"], one), F.lit(""), lambda a, s: F.concat(a, s)))
    fail = (
        F.when(F.col("v").isNull(), failure("INPUT_INVALID", "the text is not JSON"))
        .when(F.col("_m").isNull(), failure("INPUT_INVALID", "no metadata", at))
        .when(F.col("_d").isNull(), failure("INPUT_INVALID", "the metadata is no array", at))
        .when(
            F.col("_bad") > 0,
            failure("INPUT_INVALID", "a column without title or path", F.concat(at, F.lit("["), (F.col("_bad") - 1).cast("string"), F.lit("]"))),
        )
    )
    if limits.max_columns is not None:
        fail = fail.when(F.size("_d") > limits.max_columns, exceeded("max_columns", limits.max_columns, at))
    fail = fail.cast(FAIL_TYPE)
    shown = F.transform("_s", lambda c: F.struct(c["label"].alias("label"), c["steps"].alias("steps"), path(c).alias("path")))
    return found.select(key, "v", F.when(fail.isNull(), shown).alias("columns"), fail.alias("fail"))


def by_metadata(
    docs: DataFrame,
    meta: Selector,
    rows: Selector,
    content: str = "content",
    key: str = "doc_id",
    limits: Limits = Limits(),
) -> DataFrame:
    """key, row_no, labels, cells array<string>: each document's rows through the columns it describes itself.

    Documents whose description fails (see described) give no rows. Absent values are NULL.
    """
    found = described(docs, meta, limits, content, key).where("fail is null")
    labels, paths = F.transform("columns", lambda c: c["label"]), F.transform(
        "columns",
        lambda c: F.struct(c["path"].alias("path"), c["steps"].alias("steps")),
    )
    # labels and paths are made before the rows are spread, or every row would carry its whole document
    found = found.select(key, labels.alias("labels"), paths.alias("paths"), value_at(F.col("v"), rows.steps[:-1], "array<variant>").alias("rows"))
    found = found.select(key, "labels", "paths", F.posexplode("rows").alias("row_no", "row"))
    member, element = "try_element_at(try_variant_get(a, '$', 'map<string,variant>'), s.name)", "get(try_variant_get(a, '$', 'array<variant>'), s.idx)"
    stepwise = f"aggregate(p.steps, row, (a, s) -> if(s.idx is null, {member}, {element}))"
    cell = f"transform(paths, p -> if(p.path is null, try_variant_get({stepwise}, '$', 'string'), try_variant_get(row, p.path, 'string')))"
    return found.select(key, "row_no", "labels", F.expr(cell).alias("cells"))
