"""The registered queries of the document engine and their SQL oracles.

Documents are rendered from the relational tables by Spark itself, so each oracle states the
answer from the tables without any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.failures import Limits
from ..functions.paths import EACH_INDEX, EACH_MEMBER, Selector, display
from ..operators import guard, native, route, scan, table, values
from ..sources import sinks
from ..sources.decode import nodes

META, ROWS = Selector.of("meta"), Selector.of("rows", EACH_INDEX)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per customer: descriptions of two columns, then the customer's orders by key."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_totalprice").alias("total")).alias("acct"))
    meta = F.array(
        F.struct(F.lit("Identifier").alias("title"), F.array(F.lit("id")).alias("path")),
        F.struct(F.lit("Total").alias("title"), F.array(F.lit("acct"), F.lit("total")).alias("path")),
    )
    rows = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("doc_id", F.to_json(F.struct(meta.alias("meta"), "rows")).alias("content"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    got = native.by_metadata(order_documents(spark, d), META, ROWS)
    return got.select(
        "doc_id",
        F.col("row_no").cast("bigint").alias("row_no"),
        F.get("cells", F.lit(0)).cast("bigint").alias("identifier"),
        F.get("cells", F.lit(1)).cast("double").alias("total"),
    )


#: Rows of a table whose documents one task reads.
TASK_ROWS = 25_000


def _spread(docs: DataFrame, source: DataFrame) -> DataFrame:
    """docs over as many tasks as the rows of their source ask for: what a task holds does not grow with the input.
    Reading texts is bound by CPU, not by bytes, by which adaptive execution would gather them into few tasks."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, source.count() // TASK_ROWS))


def _order_nodes(spark, d):
    return nodes(_spread(order_documents(spark, d), _read(spark, d, "orders")), format="json")


def table_metadata_exact(spark, d):
    _, rows = table.table(_order_nodes(spark, d), ROWS, table.Metadata(META))
    return table.wide(rows, [("identifier", "bigint"), ("total", "double")]).withColumn("row_no", F.col("row_no") - 1)


def table_static(spark, d):
    columns = [(table.TableColumn("identifier", ("id",)), "bigint"), (table.TableColumn("total", ("acct", "total")), "double")]
    return native.native_table(order_documents(spark, d), ROWS, columns).withColumn("row_no", F.col("row_no").cast("bigint"))


def select_property(spark, d):
    e = _read(spark, d, "events")
    return e.select("event_id", native.value_at(F.try_parse_json("props"), ("k",), "bigint").alias("k"))


def select_index(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("content"))
    return v.select("vec_id", native.value_at(F.try_parse_json("content"), (3,), "float").cast("double").alias("value"))


def select_each_index(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("content"))
    return native.each(v, Selector.of(EACH_INDEX)).select(
        "vec_id",
        F.col("idx").cast("bigint").alias("idx"),
        F.try_variant_get("value", "$", "float").cast("double").alias("value"),
    )


def select_each_member(spark, d):
    o = _read(spark, d, "orders").select(
        "o_orderkey",
        F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("content"),
    )
    return native.each(o, Selector.of(EACH_MEMBER)).select("o_orderkey", "name", F.try_variant_get("value", "$", "string").alias("value"))


def select_nested(spark, d):
    got = native.each(order_documents(spark, d), Selector.of("rows", EACH_INDEX, "acct", "total"))
    return got.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.try_variant_get("value", "$", "double").alias("total"))


def value_walk_counts(spark, d):
    return values.events(_order_nodes(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def document_bytes(spark, d):
    return values.byte_sizes(_order_nodes(spark, d))


def read_metrics(spark, d):
    return guard.metrics(_order_nodes(spark, d))


def route_captures(spark, d):
    specs = [route.Capture("title", Selector.of("meta", EACH_INDEX, "title")), route.Capture("id", Selector.of("rows", EACH_INDEX, "id"))]
    return route.route(_order_nodes(spark, d), specs).select("doc_id", "ord", "tag", "path", "value")


def route_observe(spark, d):
    specs = [route.Capture("row", ROWS, "observe"), route.Capture("all", Selector(), "observe")]
    return route.route(_order_nodes(spark, d), specs).select("doc_id", "ord", "tag", "path")


def route_whole_values(spark, d):
    o = _read(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.to_json(F.struct(F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags")).alias("v"))).alias("content"),
    )
    return route.route(nodes(_spread(o, o), format="json"), [route.Capture("v", Selector.of("v"))]).select("doc_id", "path", "value", "bytes")


def table_infer_object(spark, d):
    o = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))))).alias("content")
    )
    _, rows = table.table(nodes(_spread(o, _read(spark, d, "orders")), format="json"), Selector.of(EACH_INDEX), "infer")
    return table.wide(rows.withColumn("labels", F.array_join("labels", ",")), [("k", "bigint"), ("p", "double")], also=["labels"])


def table_infer_scalar(spark, d):
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.to_json("embedding").alias("content"))
    _, rows = table.table(nodes(v, format="json"), Selector.of(EACH_INDEX), "infer")
    return table.wide(rows, [("value", "double")]).withColumn("value", F.col("value").cast("float").cast("double"))


def table_missing(spark, d):
    e = _read(spark, d, "events").select(
        F.col("event_id").alias("doc_id"),
        F.to_json(F.array(F.struct(F.col("event_id").alias("id"), F.when(F.col("value") > 50, F.col("event_type")).alias("t")))).alias("content"),
    )
    columns = [table.TableColumn("id", ("id",)), table.TableColumn("t", ("t",)), table.TableColumn("u", ("t",), "null")]
    _, rows = table.table(nodes(_spread(e, e), format="json"), Selector.of(EACH_INDEX), columns)
    return rows.select("doc_id", *[F.get("cells", F.lit(i))["kind"].alias(f"kind{i}") for i in range(3)], F.get("cells", F.lit(1))["str"].alias("t"))


def table_container_cell(spark, d):
    c = _read(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.to_json(F.array(F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")).alias("who")))).alias("content"),
    )
    _, rows = table.table(
        nodes(_spread(c, c), format="json"),
        Selector.of(EACH_INDEX),
        [table.TableColumn("who", ("who",)), table.TableColumn("n", ("who", "n"))],
    )
    return table.wide(rows, [("who", "string"), ("n", "bigint")])


def limit_scalar(spark, d):
    c = _read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.to_json(F.struct("text")).alias("content"))
    found = guard.violations(nodes(c, format="json"), Limits(max_scalar_bytes=200))
    return found.select("doc_id", "fail.code", "fail.path", "fail.limit")


def limit_capture(spark, d):
    got = route.route(_order_nodes(spark, d), [route.Capture("rows", Selector.of("rows"))], Limits(max_capture_bytes=1000))
    return got.select("doc_id", "bytes", F.col("fail.limit").alias("limit_name"), F.col("value").isNull().alias("refused"))


def path_display(spark, d):
    keys = _read(spark, d, "nation").select(
        "n_nationkey",
        F.array(
            F.struct(F.col("n_name").alias("key"), F.lit(None).cast("int").alias("idx")),
            F.struct(F.lit("a b").alias("key"), F.lit(None).cast("int").alias("idx")),
            F.struct(F.lit(None).cast("string").alias("key"), F.col("n_regionkey").alias("idx")),
        ).alias("path"),
    )
    return keys.select("n_nationkey", display(F.col("path")).alias("path"))


def scan_running_sum(spark, d):
    c = _read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return scan.running(c, "conv_id", ["turn"], F.col("n")).select("conv_id", "turn", "state")


def scan_fold(spark, d):
    c = _read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.sum(F.length("text")).alias("item"))
    return scan.scan_emit(c, "conv_id", "turn", 0, lambda s, x: (s + x, [f"+{x}"]), lambda s: [f"={s}"]).select("conv_id", "op", "out")


def _customers(spark, d):
    return _read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows")
    )


def _decoded(docs, format, row: Selector, key=("c_custkey",), name=("c_name",)):
    _, rows = table.table(nodes(docs, format=format), row, [table.TableColumn("k", key), table.TableColumn("c_name", name)])
    number = F.coalesce(F.get("cells", F.lit(0))["num"].cast("bigint"), F.get("cells", F.lit(0))["str"].cast("bigint"))
    return rows.select("doc_id", number.alias("c_custkey"), F.get("cells", F.lit(1))["str"].alias("c_name"))


def _text(spark, d, line, head="", tail="", glue="\n"):
    # few documents, which would else be read by one task
    docs = _customers(spark, d).repartition(spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("rows", line), glue), F.lit(tail)).alias("content"))


def jsonl_source(spark, d):
    return _decoded(_text(spark, d, lambda r: F.to_json(r), tail="\n"), "jsonl", Selector.of(EACH_INDEX))


def jsonc_source(spark, d):
    return _decoded(_text(spark, d, lambda r: F.concat(F.to_json(r), F.lit(", // one")), "[/* all */\n", "\n]"), "jsonc", Selector.of(EACH_INDEX))


def json5_source(spark, d):
    line = lambda r: F.concat(F.lit("{c_custkey: +0x"), F.hex(r["c_custkey"]), F.lit(", // hexadecimal\n c_name: '"), r["c_name"], F.lit("',},"))
    return _decoded(_text(spark, d, line, "[\n", "]"), "json5", Selector.of(EACH_INDEX))


def jsonic_source(spark, d):
    """Lines of pairs without quotes, commas or an outer bracket; the names' number sign stands in quotes."""
    line = lambda r: F.concat(F.lit("{c_custkey:"), r["c_custkey"].cast("string"), F.lit(" c_name:'"), r["c_name"], F.lit("'}"))
    docs = _text(spark, d, line, "# all of one nation\n", "\n,")
    return _decoded(docs, "jsonic", Selector.of(EACH_INDEX))


def zon_source(spark, d):
    line = lambda r: F.concat(F.lit(".{ .c_custkey = "), r["c_custkey"].cast("string"), F.lit(', .c_name = "'), r["c_name"], F.lit('" }'))
    return _decoded(_text(spark, d, line, ".{ ", " }", ", "), "zon", Selector.of(EACH_INDEX))


def csv_source(spark, d):
    return _decoded(
        _text(spark, d, lambda r: F.concat(r["c_custkey"].cast("string"), F.lit(',"'), r["c_name"], F.lit('"')), "c_custkey,c_name\n", "\n"),
        "csv",
        Selector.of(EACH_INDEX),
    )


def yaml_source(spark, d):
    return _decoded(
        _text(
            spark,
            d,
            lambda r: F.concat(F.lit("- c_custkey: "), r["c_custkey"].cast("string"), F.lit('\n  c_name: "'), r["c_name"], F.lit('"')),
        ),
        "yaml",
        Selector.of(EACH_INDEX),
    )


def toml_source(spark, d):
    return _decoded(
        _text(
            spark,
            d,
            lambda r: F.concat(F.lit("[[row]]\nc_custkey = "), r["c_custkey"].cast("string"), F.lit('\nc_name = "'), r["c_name"], F.lit('"')),
        ),
        "toml",
        Selector.of("row", EACH_INDEX),
    )


def ini_source(spark, d):
    return _decoded(
        _text(
            spark,
            d,
            lambda r: F.concat(
                F.lit("[s"),
                r["c_custkey"].cast("string"),
                F.lit("]\nc_custkey = "),
                r["c_custkey"].cast("string"),
                F.lit("\nc_name = "),
                r["c_name"],
            ),
        ),
        "ini",
        Selector.of(EACH_MEMBER),
    )


def xml_source(spark, d):
    line = lambda r: F.concat(F.lit('<r k="'), r["c_custkey"].cast("string"), F.lit('">'), r["c_name"], F.lit("</r>"))
    return _decoded(_text(spark, d, line, "<all>", "</all>", ""), "xml", Selector.of("children", EACH_INDEX), ("attributes", "k"), ("children", 0))


def records_json(spark, d):
    _, rows = table.table(_order_nodes(spark, d), ROWS, [table.TableColumn("id", ("id",)), table.TableColumn("gone", ("gone",))])
    return sinks.records(rows).select("doc_id", "row_no", "record")


def csv_text(spark, d):
    c = _read(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.to_json(F.array(F.struct("c_custkey", F.concat(F.lit('"'), "c_name").alias("c_name")))).alias("content"),
    )
    _, rows = table.table(
        nodes(_spread(c, c), format="json"),
        Selector.of(EACH_INDEX),
        [table.TableColumn("k", ("c_custkey",)), table.TableColumn("n", ("c_name",)), table.TableColumn("x", ("x",))],
    )
    return sinks.csv_lines(rows).select("doc_id", "line")


_ROWS = "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, o_orderkey AS identifier, o_totalprice AS total FROM orders"
_PER = "WITH c AS (SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1) "
_CUSTOMER = "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer"

#: name: (query, SQL)
_ALL = {
    "table_metadata": (flagship, _ROWS),
    "table_metadata_exact": (table_metadata_exact, _ROWS),
    "table_static": (table_static, _ROWS),
    "select_property": (select_property, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "select_index": (select_index, "SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS value FROM embeddings"),
    "select_each_index": (
        select_each_index,
        "SELECT vec_id, CAST(i - 1 AS BIGINT) AS idx, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)",
    ),
    "select_each_member": (
        select_each_member,
        "SELECT o_orderkey, 'status' AS name, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders",
    ),
    "select_nested": (
        select_nested,
        "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_totalprice AS total FROM orders",
    ),
    "value_walk_counts": (
        value_walk_counts,
        _PER + "SELECT doc_id, k.kind, CASE k.kind WHEN 'key' THEN 6 + 3 * n WHEN 'string' THEN 5 WHEN 'number' THEN 2 * n WHEN 'end' THEN 1 WHEN 'array_start' THEN 4 WHEN 'array_end' THEN 4 ELSE 3 + 2 * n END AS n FROM c, (VALUES ('key'), ('string'), ('number'), ('end'), ('array_start'), ('array_end'), ('object_start'), ('object_end')) AS k(kind)",
    ),
    "document_bytes": (document_bytes, _PER + "SELECT doc_id, 244 + 91 * n AS bytes FROM c"),
    "read_metrics": (
        read_metrics,
        _PER + "SELECT doc_id, 2 * (3 + 2 * n) + 8 + (6 + 3 * n) + 5 + 2 * n + 1 AS events, 6 + 3 * n AS keys, 5 + 2 * n AS scalars FROM c",
    ),
    "route_captures": (
        route_captures,
        "SELECT o_custkey AS doc_id, t.i AS ord, 'title' AS tag, '.meta[' || t.i || '].title' AS path, t.v AS value FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES (CAST(0 AS BIGINT), '\"Identifier\"'), (CAST(1 AS BIGINT), '\"Total\"')) AS t(i, v) UNION ALL SELECT o_custkey, 1 + row_number() OVER w, 'id', '.rows[' || (row_number() OVER w - 1) || '].id', CAST(o_orderkey AS VARCHAR) FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "route_observe": (
        route_observe,
        "SELECT o_custkey AS doc_id, row_number() OVER w - 1 AS ord, 'row' AS tag, '.rows[' || (row_number() OVER w - 1) || ']' AS path FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) UNION ALL SELECT o_custkey, count(*), 'all', '.' FROM orders GROUP BY o_custkey",
    ),
    "route_whole_values": (
        route_whole_values,
        "SELECT o_orderkey AS doc_id, '.v' AS path, '{\"o_orderkey\":' || o_orderkey || ',\"tags\":[\"' || o_orderstatus || '\",\"' || o_orderpriority || '\"]}' AS value, CAST(16 + 16 + 10 + 8 + 16 + 4 + 32 + strlen(o_orderstatus) + strlen(o_orderpriority) AS BIGINT) AS bytes FROM orders",
    ),
    "table_infer_object": (
        table_infer_object,
        "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, o_orderkey AS k, o_totalprice AS p, 'k,p' AS labels FROM orders",
    ),
    "table_infer_scalar": (
        table_infer_scalar,
        "SELECT vec_id AS doc_id, CAST(i AS BIGINT) AS row_no, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)",
    ),
    "table_missing": (
        table_missing,
        "SELECT event_id AS doc_id, 'number' AS kind0, CASE WHEN value > 50 THEN 'string' ELSE 'missing' END AS kind1, CASE WHEN value > 50 THEN 'string' ELSE 'null' END AS kind2, CASE WHEN value > 50 THEN event_type END AS t FROM events",
    ),
    "table_container_cell": (
        table_container_cell,
        "SELECT c_custkey AS doc_id, CAST(1 AS BIGINT) AS row_no, '{\"name\":\"' || c_name || '\",\"n\":' || c_nationkey || '}' AS who, CAST(c_nationkey AS BIGINT) AS n FROM customer",
    ),
    "limit_scalar": (
        limit_scalar,
        "SELECT conv_id || '-' || turn AS doc_id, 'RESOURCE_LIMIT_EXCEEDED' AS code, '.text' AS path, 'max_scalar_bytes' AS \"limit\" FROM conversations WHERE strlen(text) > 200",
    ),
    "limit_capture": (
        limit_capture,
        _PER + "SELECT doc_id, 16 + 91 * n AS bytes, CASE WHEN 16 + 91 * n > 1000 THEN 'max_capture_bytes' END AS limit_name, 16 + 91 * n > 1000 AS refused FROM c",
    ),
    "path_display": (
        path_display,
        "SELECT n_nationkey, '.' || CASE WHEN regexp_matches(n_name, '^[A-Za-z_][A-Za-z0-9_]*$') THEN n_name ELSE '\"' || n_name || '\"' END || '.\"a b\"[' || n_regionkey || ']' AS path FROM nation",
    ),
    "scan_running_sum": (
        scan_running_sum,
        "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS state FROM conversations",
    ),
    "scan_fold": (
        scan_fold,
        "WITH t AS (SELECT conv_id, turn, sum(length(text)) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS op, '+' || n AS out FROM t UNION ALL SELECT conv_id, -1, '=' || sum(n) FROM t GROUP BY conv_id",
    ),
    "jsonl_source": (jsonl_source, _CUSTOMER),
    "jsonc_source": (jsonc_source, _CUSTOMER),
    "json5_source": (json5_source, _CUSTOMER),
    "jsonic_source": (jsonic_source, _CUSTOMER),
    "zon_source": (zon_source, _CUSTOMER),
    "csv_source": (csv_source, _CUSTOMER),
    "yaml_source": (yaml_source, _CUSTOMER),
    "toml_source": (toml_source, _CUSTOMER),
    "ini_source": (ini_source, _CUSTOMER),
    "xml_source": (xml_source, _CUSTOMER),
    "records_json": (
        records_json,
        "SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, '{\"id\":' || o_orderkey || '}' AS record FROM orders",
    ),
    "csv_text": (csv_text, "SELECT c_custkey AS doc_id, '\"' || c_custkey || '\",\"\"\"' || c_name || '\",\"\"' AS line FROM customer"),
}


def _all() -> dict:
    from . import rules

    return _ALL | rules.ALL


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
