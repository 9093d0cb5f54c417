"""Tables from documents: row scopes projected into columns that are declared, inferred from the
first row, or described by metadata inside each document.

The nodes of a document meet once, in one exchange by document: each row scope and each metadata
scope becomes one row that holds its nodes in order, windows over the document bring the columns to
its rows, and a cell is looked up among its row's nodes. So a document is decoded once for each
action and nothing is joined. A row scope is bounded by max_record_bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.failures import FAIL_TYPE, NODE_BYTES, Limits, PlanFailure, exceeded, failure
from ..functions.paths import PATH_TYPE, Selector, display
from .route import Capture, checked
from .values import CELL_TYPE, fragments, node_bytes, of_node

COLUMNS_TYPE = "array<struct<no: int, label: string, source: string, missing: string>>"


@dataclass(frozen=True)
class TableColumn:
    label: str
    source: tuple
    missing: str = "missing"  # or "null", "error"


@dataclass(frozen=True)
class Metadata:
    """Where each document describes its columns: an array of {"title": text, "path": [steps]}."""

    select: Selector


def _source(steps) -> str:
    return str(Selector(tuple(steps)))


def _static(columns: list[TableColumn], limits: Limits) -> Column:
    if limits.max_columns is not None and len(columns) > limits.max_columns:
        raise PlanFailure("RESOURCE_LIMIT_EXCEEDED", "more than max_columns")
    made = [F.struct(F.lit(i).alias("no"), F.lit(c.label).alias("label"), F.lit(_source(c.source)).alias("source"), F.lit(c.missing).alias("missing")) for i, c in enumerate(columns)]
    return F.array(*made).cast(COLUMNS_TYPE)


def _inferred(items: Column, kind: Column) -> Column:
    """The columns of a first row: its members or elements, or itself as ``value``."""
    inner = F.filter(items, lambda i: F.size(i["rel"]) == 1)
    step = lambda i: F.get(i["rel"], F.lit(0))
    many = F.transform(
        inner,
        lambda i, n: F.struct(
            n.alias("no"),
            F.coalesce(step(i)["key"], step(i)["idx"].cast("string")).alias("label"),
            i["at"].alias("source"),
            F.lit("missing").alias("missing"),
        ),
    )
    one = F.array(F.struct(F.lit(0).alias("no"), F.lit("value").alias("label"), F.lit(".").alias("source"), F.lit("missing").alias("missing")))
    return F.when(kind.isin("object", "array"), many.cast(COLUMNS_TYPE)).otherwise(one.cast(COLUMNS_TYPE))


def _described(items: Column) -> Column:
    """array<struct<no, label, source, missing, good>>: one for each element of a metadata scope."""
    at = lambda i, n, name: F.get(i["rel"], F.lit(n))[name]
    elements = F.filter(items, lambda i: (F.size(i["rel"]) == 1) & at(i, 0, "idx").isNotNull())

    def column(e: Column) -> Column:
        inside = F.slice(items, (e["pre"] - F.element_at(items, 1)["pre"] + 1).cast("int"), (e["last"] - e["pre"] + 1).cast("int"))
        child = lambda i, name, kind: (F.size(i["rel"]) == 2) & F.coalesce(at(i, 1, "key") == name, F.lit(False)) & (i["kind"] == kind)
        title = F.get(F.filter(inside, lambda i: child(i, "title", "string")), F.lit(0))["str"]
        has_path = F.exists(inside, lambda i: child(i, "path", "array"))
        steps = F.filter(inside, lambda i: (F.size(i["rel"]) == 3) & F.coalesce(at(i, 1, "key") == "path", F.lit(False)))
        is_index = lambda i: (i["kind"] == "number") & (i["num"] >= 0) & (i["num"] == F.floor(i["num"])) & (i["num"] < 2**31)
        fit = F.forall(steps, lambda i: F.coalesce((i["kind"] == "string") | is_index(i), F.lit(False)))
        path = F.transform(
            steps,
            lambda i: F.struct(
                F.when(i["kind"] == "string", i["str"]).alias("key"),
                F.when(F.coalesce(is_index(i), F.lit(False)), i["num"]).cast("int").alias("idx"),
            ),
        ).cast(PATH_TYPE)
        good = title.isNotNull() & has_path & fit
        return F.struct(
            at(e, 0, "idx").alias("no"),
            title.alias("label"),
            display(path).alias("source"),
            F.lit("missing").alias("missing"),
            good.alias("good"),
        )

    return F.transform(elements, column)


def _too_many(columns: Column, bytes_: Column, path: Column, limits: Limits) -> Column:
    """The failure of a schema above max_metadata_bytes or max_columns, or null."""
    fail = F.lit(None).cast(FAIL_TYPE)
    if limits.max_columns is not None:
        fail = F.when(F.size(columns) > limits.max_columns, exceeded("max_columns", limits.max_columns, path).cast(FAIL_TYPE)).otherwise(fail)
    if limits.max_metadata_bytes is not None:
        fail = F.when(
            bytes_ > limits.max_metadata_bytes,
            exceeded("max_metadata_bytes", limits.max_metadata_bytes, path).cast(FAIL_TYPE),
        ).otherwise(fail)
    return fail


def _scopes(nodes: DataFrame, rows: Selector, meta: Selector | None, key: str, wanted: str) -> DataFrame:
    """key, scope ("d" document, "m" metadata, "r" row), pos, last, bytes, path, kind, items: one row per scope,
    and one per document. items are the nodes in order of the scopes whose letters are wanted, their paths taken from
    the scope (rel, and as text: at)."""
    held = [F.when(F.size("path") == 0, F.struct(F.lit("d").alias("scope"), F.lit(0).alias("steps")))]
    for name, selector in (("m", meta), ("r", rows)):
        if selector is not None:
            held.append(F.when(selector.covers(F.col("path")), F.struct(F.lit(name).alias("scope"), F.lit(len(selector.steps)).alias("steps"))))
    part = nodes.where("pre is not null").withColumn("_s", F.explode(F.array_compact(F.array(*held))))
    steps = F.col("_s.steps")
    part = part.withColumn("_pos", F.get("ancestors", steps)).withColumn(
        "_rel",
        F.slice("path", steps + 1, F.greatest(F.size("path") - steps, F.lit(0))),
    )
    is_root = F.col("pre") == F.col("_pos")
    item = F.struct(
        "pre",
        "last",
        "depth",
        "kind",
        "bool",
        "num",
        "lexeme",
        "str",
        F.col("_rel").alias("rel"),
        display(F.col("_rel")).alias("at"),
        of_node("key").alias("key"),
        of_node("parent").alias("parent"),
    )
    got = part.groupBy(key, F.col("_s.scope").alias("scope"), F.col("_pos").alias("pos")).agg(
        F.max("last").alias("last"),
        F.sum(node_bytes(is_root)).alias("bytes"),
        F.max(F.when(is_root, F.struct(display(F.col("path")).alias("path"), "kind"))).alias("_at"),
        F.sort_array(F.collect_list(F.when(F.col("_s.scope").isin(*wanted), item))).alias("items") if wanted else F.lit(None).alias("items"),
    )
    return got.select(key, "scope", "pos", "last", "bytes", "_at.path", "_at.kind", "items")


def _cells(items: Column, columns: Column) -> Column:
    """The cells of one row, null where a column's source is not in it."""

    def text(top: Column) -> Column:
        first = F.element_at(items, 1)["pre"]
        inside = F.slice(items, (top["pre"] - first + 1).cast("int"), (top["last"] - top["pre"] + 1).cast("int"))
        pieces = F.transform(inside, lambda i: fragments(i["pre"] == top["pre"], lambda name: i[name]))
        return F.array_join(F.transform(F.sort_array(F.flatten(pieces)), lambda p: p["text"]), "")

    def cell(c: Column) -> Column:
        # a list of none or one, so that what is found is named once
        found = F.slice(F.filter(items, lambda i: i["at"] == c["source"]), 1, 1)

        def shown(top: Column) -> Column:
            container = top["kind"].isin("object", "array")
            scalar = F.struct(*[top[n].alias(n) for n in ("kind", "bool", "num", "lexeme", "str")])
            as_text = F.struct(
                F.lit("string").alias("kind"),
                F.lit(None).cast("boolean").alias("bool"),
                F.lit(None).cast("double").alias("num"),
                F.lit(None).cast("string").alias("lexeme"),
                text(top).alias("str"),
            )
            return F.when(container, as_text.cast(CELL_TYPE)).otherwise(scalar.cast(CELL_TYPE))

        return F.get(F.transform(found, shown), F.lit(0))

    return F.transform(columns, cell)


def _empty(kind: str) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        null.cast("boolean").alias("bool"),
        null.cast("double").alias("num"),
        null.cast("string").alias("lexeme"),
        null.cast("string").alias("str"),
    ).cast(CELL_TYPE)


def _full(nodes: DataFrame, rows: Selector, schema, limits: Limits, key: str, cells: bool) -> DataFrame:
    """The scopes of each document with row_no, columns, fail (of the document's columns), _stop (its first broken row)
    and, where cells are wanted or a broken row shows in them, _got (a row's cells)."""
    meta = schema.select if isinstance(schema, Metadata) else None
    if meta is not None:
        checked([Capture("metadata", meta), Capture("row", rows)])
    static = _static(schema, limits) if isinstance(schema, list) else None
    strict = isinstance(schema, list) and any(c.missing == "error" for c in schema)
    cells = cells or strict
    wanted = "mr" if cells or schema == "infer" else "m" if meta is not None else ""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the nodes of a document come from one task as it is; together once, they need no other exchange
    s = _scopes(nodes.repartition(partitions, key), rows, meta, key, wanted)
    is_row, is_meta = F.col("scope") == "r", F.col("scope") == "m"
    whole = Window.partitionBy(key)
    s = s.withColumn("row_no", F.when(is_row, F.row_number().over(Window.partitionBy(key, "scope").orderBy("pos"))).cast("long"))
    none = F.array().cast(COLUMNS_TYPE)
    if static is not None:
        s = s.withColumn("columns", static).withColumn("fail", F.lit(None).cast(FAIL_TYPE))
    elif meta is None:
        first = F.col("row_no") == 1
        made = F.when(first, _inferred(F.col("items"), F.col("kind")))
        s = s.withColumn("_made", made)
        names = F.aggregate("_made", F.lit(0).cast("long"), lambda a, c: a + F.octet_length(c["label"])) + (F.size("_made") + 1) * NODE_BYTES
        s = s.withColumn("_why", F.when(first, _too_many(F.col("_made"), names, F.col("path"), limits)))
        s = s.withColumn(
            "columns",
            F.coalesce(F.first("_made", True).over(whole), none),
        ).withColumn("fail", F.first("_why", True).over(whole)).drop("_made", "_why")
    else:
        s = s.withColumn("_nth", F.when(is_meta, F.row_number().over(Window.partitionBy(key, "scope").orderBy("pos"))))
        s = s.withColumn("_made", F.when(F.col("_nth") == 1, _described(F.col("items"))))
        bad = F.get(F.filter("_made", lambda c: ~c["good"]), F.lit(0))["no"]
        about = F.struct("_made", bad.alias("bad"), F.col("last").alias("done"), "bytes", "path", "kind")
        s = s.withColumn("_m", F.first(F.when(F.col("_nth") == 1, about), True).over(whole))
        s = s.withColumn("_again", F.first(F.when(F.col("_nth") == 2, F.col("path")), True).over(whole))
        s = s.withColumn("_row", F.first(F.when(F.col("row_no") == 1, F.struct("pos", "path")), True).over(whole))
        late = failure("INPUT_ORDER_VIOLATION", "a row is there ahead of the columns", F.col("_row.path"))
        absent = F.col("_m").isNull()
        fail = (
            F.when(F.col("_row").isNotNull() & (absent | (F.col("_row.pos") <= F.col("_m.done"))), late.cast(FAIL_TYPE))
            .when(absent, failure("INPUT_INVALID", "no metadata", F.lit(str(meta))).cast(FAIL_TYPE))
            .when(F.col("_m.kind") != "array", failure("INPUT_INVALID", "the metadata is no array", F.col("_m.path")).cast(FAIL_TYPE))
            .when(
                F.col("_m.bad").isNotNull(),
                failure(
                    "INPUT_INVALID",
                    "a column without title or path",
                    F.concat(F.col("_m.path"), F.lit("["), F.col("_m.bad").cast("string"), F.lit("]")),
                ).cast(FAIL_TYPE),
            )
            .when(F.col("_again").isNotNull(), failure("INPUT_ORDER_VIOLATION", "metadata twice", F.col("_again")).cast(FAIL_TYPE))
            .otherwise(_too_many(F.col("_m._made"), F.col("_m.bytes"), F.col("_m.path"), limits))
        )
        plain = F.transform(
            "_m._made",
            lambda c: F.struct(c["no"].alias("no"), c["label"].alias("label"), c["source"].alias("source"), c["missing"].alias("missing")),
        )
        s = s.withColumn("columns", F.coalesce(plain.cast(COLUMNS_TYPE), none)).withColumn("fail", fail).drop("_nth", "_made", "_m", "_again", "_row")

    good_row = is_row & F.col("fail").isNull()
    broken = F.lit(None).cast(FAIL_TYPE)
    if cells:
        s = s.withColumn("_got", F.when(good_row, _cells(F.col("items"), F.col("columns"))))
    if strict:
        lost = F.filter(F.arrays_zip(F.col("columns").alias("c"), F.col("_got").alias("g")), lambda z: (z["c"]["missing"] == "error") & z["g"].isNull())
        inside = F.regexp_replace(F.get(lost, F.lit(0))["c"]["source"], r"^\.$", "")
        broken = F.when(F.size(lost) > 0, failure("MISSING_VALUE", "a value is missing", F.concat("path", inside)).cast(FAIL_TYPE))
    if limits.max_record_bytes is not None:
        broken = F.when(
            F.col("bytes") > limits.max_record_bytes,
            exceeded("max_record_bytes", limits.max_record_bytes, F.col("path")).cast(FAIL_TYPE),
        ).otherwise(broken)
    full = s.drop("items").withColumn("_broken", F.when(good_row, broken))
    return full.withColumn("_stop", F.min(F.when(F.col("_broken").isNotNull(), F.struct("row_no", F.col("_broken").alias("why")))).over(whole))


#: A row is there if its document's columns are known and no row before it, nor itself, is broken.
_KEPT = "scope = 'r' and fail is null and (_stop is null or row_no < _stop.row_no)"


def _labels() -> Column:
    return F.transform("columns", lambda c: c["label"])


def table(
    nodes: DataFrame,
    rows: Selector,
    schema: list[TableColumn] | Metadata | str,
    limits: Limits = Limits(),
    key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(schemas, rows). schemas: key, labels, fail, n_rows, one row per document. rows: key, row_no (from 1), cells
    array<cell>, in schema order, and labels, the same for all rows of a document. A cell's kind is null, bool, number,
    string or missing; a container is its compact JSON as a string. The rows before a document's failing row stay;
    fail tells of it, n_rows counts them. Each of the two reads the documents once; what is in one needs no join.
    """
    full = _full(nodes, rows, schema, limits, key, True)
    filled = F.transform(
        "columns",
        lambda c, n: F.coalesce(F.get(F.col("_got"), n), F.when(c["missing"] == "null", _empty("null")).otherwise(_empty("missing"))),
    )
    out = full.where(_KEPT).select(key, "row_no", filled.alias("cells"), _labels().alias("labels"))
    about = F.struct(_labels().alias("labels"), F.coalesce("fail", "_stop.why").alias("fail"))
    lean = _full(nodes, rows, schema, limits, key, False)
    schemas = lean.groupBy(key).agg(F.first(F.when(F.col("scope") == "d", about), True).alias("_d"), F.count_if(F.expr(_KEPT)).alias("n_rows"))
    return schemas.select(key, "_d.labels", "_d.fail", "n_rows"), out


def wide(rows: DataFrame, columns: list[tuple[str, str]], key: str = "doc_id", also: list[str] = []) -> DataFrame:
    """rows with one typed column per (name, type) in place of cells, and the columns of rows named in also; missing
    and null are both NULL."""
    field = {"double": "num", "bigint": "num", "int": "num", "boolean": "bool"}
    one = lambda i, kind: F.get("cells", F.lit(i))[field.get(kind, "str")].cast(kind)
    return rows.select(key, "row_no", *[one(i, kind).alias(name) for i, (name, kind) in enumerate(columns)], *also)
