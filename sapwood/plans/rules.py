"""Registered queries of the engine's rules: contracts, limits, failures, repeats, numbers, natural order.

Like those of catalogue.py they run over whole tables: documents and events are rendered from the
tables, faults are planted by column expressions, and each oracle states the answer from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.failures import Limits
from ..functions.paths import EACH_INDEX, EACH_MEMBER, Selector, natural_keys, overlap
from ..operators import contract, guard, native, route, scan, table, values
from ..sources import sinks
from ..sources.decode import nodes
from .catalogue import META, ROWS, _order_nodes, _read, _spread, order_documents

_ROWS_OF = "SELECT o_custkey AS doc_id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders"
_DOCS = "SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1"


def _faulty_events(spark, d):
    """The events of the order documents; by the number of a document one of the first events is changed or gone."""
    e = values.events(_order_nodes(spark, d)).select("doc_id", "seq", "kind", "key_name")
    case, at = F.col("doc_id") % 8, lambda n: F.col("seq") == n
    gone = ((case == 2) & at(4)) | ((case == 4) & at(5)) | ((case == 6) & at(0))
    kind = F.when((case == 3) & at(9), "object_end").when((case == 5) & at(8), "key").when((case == 7) & at(8), "end").otherwise(F.col("kind"))
    name = F.when((case == 1) & at(6), "title").when((case == 5) & at(8), "x").otherwise(F.col("key_name"))
    return e.where(~gone).select("doc_id", "seq", kind.alias("kind"), name.alias("key_name"))


_FAULT_AT = "CASE doc_id % 8 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 9 WHEN 4 THEN 6 WHEN 5 THEN 8 WHEN 6 THEN 1 ELSE 8 END"


def tree_contract(spark, d):
    return contract.tree_contract(_faulty_events(spark, d))


def protocol_errors(spark, d):
    return contract.protocol_errors(_faulty_events(spark, d))


def _repeated(spark, d):
    """Documents in which every third order has a member twice inside, and all have one twice at the top."""
    o = _read(spark, d, "orders")
    again = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(',"p":'), F.col("o_custkey").cast("string"))).otherwise("")
    text = F.concat(
        F.lit('{"k":'),
        F.col("o_orderkey").cast("string"),
        F.lit(',"in":{"p":1'),
        again,
        F.lit('},"k":'),
        F.col("o_custkey").cast("string"),
        F.lit("}"),
    )
    return _spread(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("content")), o)


def duplicates_policies(spark, d):
    return values.json_texts(_repeated(spark, d), ["last_wins", "first_wins"])


def duplicates_rejected(spark, d):
    return route.duplicates_inside(nodes(_repeated(spark, d), format="json", duplicates="all"), route.Capture("each", Selector.of(EACH_MEMBER)))


def overlap_matrix(spark, d):
    """Two selectors of two steps for each line of an order; can they meet?"""

    def step(n, key):
        fields = F.when(
            n % 4 == 2,
            F.concat(F.lit("k"), key.cast("string")),
        ), F.when(n % 4 == 3, key.cast("int")), F.when(n % 4 == 0, "member").when(n % 4 == 1, "index")
        return F.struct(*[f.alias(name) for f, name in zip(fields, ("key", "idx", "each"), strict=True)])

    c = F.col
    a = F.array(step(c("l_orderkey"), c("l_linenumber") % 2), step(c("l_partkey"), c("l_suppkey") % 2))
    b = F.when(c("l_suppkey") % 5 == 0, F.array(step(c("l_suppkey"), c("l_orderkey") % 2))).otherwise(
        F.array(step(c("l_suppkey"), c("l_orderkey") % 2), step(c("l_linenumber"), c("l_partkey") % 2))
    )
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", overlap(a, b).alias("overlap"))


def _meet(a: str, ka: str, b: str, kb: str) -> str:
    """SQL: can two steps meet, given their kinds 0 each member, 1 each element, 2 name, 3 number."""
    return f"((({a}) % 2 = ({b}) % 2) AND (({a}) < 2 OR ({b}) < 2 OR ({ka}) = ({kb})))"


_FIRST = _meet("l_orderkey % 4", "l_linenumber % 2", "l_suppkey % 4", "l_orderkey % 2")
_SECOND = _meet("l_partkey % 4", "l_suppkey % 2", "l_linenumber % 4", "l_partkey % 2")


def _number_words(spark, d):
    """Every order's price in cents as an integer, and a power of ten from -300 to 299: number texts of each size."""
    o = _read(spark, d, "orders")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("m"), (F.col("o_orderkey") * 7919 % 600 - 300).alias("e"))


_WORDS = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS m, o_orderkey * 7919 % 600 - 300 AS e FROM orders"


def number_text(spark, d):
    w = _number_words(spark, d)
    num = F.concat(F.col("m").cast("string"), F.lit("e"), F.col("e").cast("string")).cast("double")
    return w.select("o_orderkey", values.number_text(F.when(F.col("o_orderkey") % 2 == 0, num).otherwise(-num)).alias("text"))


_NUMBER_TEXT = f"""
WITH w AS ({_WORDS}), t AS (SELECT o_orderkey, rtrim(CAST(m AS VARCHAR), '0') AS digits, length(CAST(m AS VARCHAR)) + e AS point FROM w)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '-' END || CASE
    WHEN point <= 0 THEN '0.' || repeat('0', CAST(-point AS INTEGER)) || digits
    WHEN point >= length(digits) THEN digits || repeat('0', CAST(point - length(digits) AS INTEGER))
    ELSE substr(digits, 1, point) || '.' || substr(digits, point + 1) END AS text FROM t"""


def lexeme_rule(spark, d):
    """Number texts, by the order's number with something before or after: which are JSON numbers, which keep their text."""
    w = _number_words(spark, d)
    m, case = F.col("m").cast("string"), F.col("o_orderkey") % 7
    text = F.when(case == 0, m).when(case == 1, F.concat(m, F.lit(".50"))).when(case == 2, F.concat(F.lit("0"), m)).when(case == 3, F.concat(F.lit("+"), m)).when(case == 4, F.concat(m, F.lit("."))).when(
        case == 5,
        F.concat(F.lit("-"), m, F.lit("E+2")),
    ).otherwise(F.concat(F.lit("x"), m))
    t = w.select("o_orderkey", text.alias("lexeme"))
    num = F.col("lexeme").try_cast("double")
    return t.select(
        "o_orderkey",
        "lexeme",
        values.is_json_number(F.col("lexeme")).alias("json_number"),
        values.keeps_lexeme(F.col("lexeme"), num).alias("kept"),
        values.number_text(num).alias("shown"),
    )


_LEXEME_RULE = f"""
WITH w AS ({_WORDS}) SELECT o_orderkey,
    CASE o_orderkey % 7 WHEN 0 THEN '' || m WHEN 1 THEN m || '.50' WHEN 2 THEN '0' || m WHEN 3 THEN '+' || m WHEN 4 THEN m || '.' WHEN 5 THEN '-' || m || 'E+2' ELSE 'x' || m END AS lexeme,
    o_orderkey % 7 IN (0, 1, 5) AS json_number, o_orderkey % 7 IN (0, 1, 5) AS kept,
    CASE o_orderkey % 7 WHEN 1 THEN m || '.5' WHEN 5 THEN '-' || m || '00' WHEN 6 THEN NULL ELSE '' || m END AS shown FROM w"""


def _described_documents(spark, d):
    """Order documents whose description or place is at fault, by the customer's number."""
    docs, case = order_documents(spark, d), F.col("doc_id") % 7
    meta = F.regexp_extract("content", r'^\{"meta":(.*?),"rows":', 1)
    rows = F.regexp_extract("content", r',"rows":(.*)\}$', 1)
    whole = lambda m, r=rows: F.concat(F.lit('{"meta":'), m, F.lit(',"rows":'), r, F.lit("}"))
    text = (
        F.when(case == 0, F.concat(F.lit('{"rows":'), rows, F.lit(',"meta":'), meta, F.lit("}")))
        .when(case == 1, F.lit('{"other":1}'))
        .when(case == 2, whole(F.lit('[{"title":"Key","path":["id"]},{"path":["acct"]}]')))
        .when(case == 3, whole(F.lit('{"title":"Key"}')))
        .when(case == 4, whole(F.lit('[{"title":"Key","path":["id",-2]}]')))
        .when(case == 5, whole(meta, F.lit("[]")))
        .otherwise(F.col("content"))
    )
    return docs.select("doc_id", text.alias("content"))


def _described_nodes(spark, d):
    return nodes(_spread(_described_documents(spark, d), _read(spark, d, "orders")), format="json")


def order_violation(spark, d):
    schemas, _ = table.table(_described_nodes(spark, d), ROWS, table.Metadata(META))
    return schemas.where("fail is not null").select("doc_id", "fail.code", "fail.path")


_CODES = "CASE doc_id % 7 WHEN 0 THEN 'INPUT_ORDER_VIOLATION' ELSE 'INPUT_INVALID' END AS code, CASE doc_id % 7 WHEN 0 THEN '.rows[0]' WHEN 2 THEN '.meta[1]' WHEN 4 THEN '.meta[0]' ELSE '.meta' END AS path"


def native_failures(spark, d):
    found = native.described(_described_documents(spark, d), META)
    return found.where("fail is not null").select("doc_id", "fail.code", "fail.path")


def table_zero_rows(spark, d):
    schemas, _ = table.table(_described_nodes(spark, d), ROWS, table.Metadata(META))
    return schemas.where("fail is null").select("doc_id", F.array_join("labels", ",").alias("labels"), "n_rows")


def native_steps(spark, d):
    """Columns by index, by names with quotes of either or both kinds, in documents that describe them."""
    o = _read(spark, d, "orders")
    line = F.concat(
        F.lit('{"tags":["'),
        F.col("o_orderstatus"),
        F.lit('",'),
        F.col("o_orderkey").cast("string"),
        F.lit("],\"odd 'name\":"),
        F.col("o_custkey").cast("string"),
        F.lit(",\"both '\\\"\":{\"in\":\""),
        F.col("o_orderpriority"),
        F.lit('"}}'),
    )
    meta = '[{"title":"a","path":["tags",0]},{"title":"b","path":["tags",1]},{"title":"c","path":["odd \'name"]},{"title":"d","path":["both \'\\"","in"]},{"title":"e","path":["tags",2]}]'
    docs = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line"))))["line"], ",").alias("lines")
    )
    docs = docs.select("doc_id", F.concat(F.lit('{"meta":' + meta + ',"rows":['), "lines", F.lit("]}")).alias("content"))
    got = native.by_metadata(docs, META, ROWS)
    return got.select(
        "doc_id",
        F.col("row_no").cast("bigint").alias("row_no"),
        *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate("abcde")],
    )


def _arrays(spark, d, of):
    o = _read(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", of.alias("t"))))["t"], ","), F.lit("]")).alias("content")
    )


def table_infer_array(spark, d):
    docs = _arrays(spark, d, F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit('"]')))
    _, rows = table.table(nodes(_spread(docs, _read(spark, d, "orders")), format="json"), Selector.of(EACH_INDEX), "infer")
    return table.wide(rows.withColumn("labels", F.array_join("labels", ",")), [("k", "bigint"), ("status", "string")], also=["labels"])


def table_infer_mixed(spark, d):
    """Rows of several kinds: the first one's kind decides, and rows of another kind have no cells of it."""
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    row = F.when(
        F.col("o_orderkey") % 3 == 0,
        F.concat(F.lit('{"k":'), key, F.lit("}")),
    ).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("["), key, F.lit("]"))).otherwise(F.concat(F.lit('"'), status, F.lit('"')))
    docs = _spread(_arrays(spark, d, row), _read(spark, d, "orders"))
    _, rows = table.table(nodes(docs, format="json"), Selector.of(EACH_INDEX), "infer")
    cell = F.get("cells", F.lit(0))
    return rows.select(
        "doc_id",
        "row_no",
        cell["kind"].alias("kind"),
        F.coalesce(cell["num"].cast("bigint").cast("string"), cell["str"]).alias("shown"),
        F.array_join("labels", ",").alias("labels"),
    )


_INFER_MIXED = f"""
WITH r AS ({_ROWS_OF}), s AS (SELECT r.*, o.o_orderstatus AS st, first_value(r.o_orderkey % 3) OVER (PARTITION BY r.doc_id ORDER BY r.n) AS lead FROM r JOIN orders AS o USING (o_orderkey))
SELECT doc_id, n AS row_no, CASE lead WHEN 0 THEN 'k' WHEN 1 THEN '0' ELSE 'value' END AS labels,
    CASE WHEN lead < 2 THEN CASE WHEN o_orderkey % 3 = lead THEN 'number' ELSE 'missing' END ELSE 'string' END AS kind,
    CASE WHEN lead < 2 THEN CASE WHEN o_orderkey % 3 = lead THEN '' || o_orderkey END
         WHEN o_orderkey % 3 = 0 THEN '{{"k":' || o_orderkey || '}}' WHEN o_orderkey % 3 = 1 THEN '[' || o_orderkey || ']' ELSE st END AS shown FROM s"""


def _fails(schemas):
    return schemas.where("fail is not null").select("doc_id", "fail.code", "fail.limit", "fail.path")


def limit_depth(spark, d):
    found = guard.violations(_order_nodes(spark, d), Limits(max_depth=3))
    return found.select("doc_id", "fail.code", "fail.limit", "fail.path")


def limit_key(spark, d):
    c = _read(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.to_json(F.array(F.create_map(F.repeat(F.lit("é"), (F.col("c_custkey") % 9).cast("int")), F.lit(1)))).alias("content"),
    )
    found = guard.violations(nodes(_spread(c, c), format="json"), Limits(max_key_bytes=9))
    return found.select("doc_id", "fail.code", "fail.limit", "fail.path")


def limit_record(spark, d):
    """Rows are lists of the flags of an order's lines; the first beyond the limit ends its document."""
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list("l_returnflag"))).alias("t"))
    docs = lines.groupBy((F.col("l_orderkey") % 500).alias("doc_id")).agg(
        F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("l_orderkey", "t")))["t"], ","), F.lit("]")).alias("content")
    )
    docs = _spread(docs, _read(spark, d, "lineitem"))
    schemas, _ = table.table(nodes(docs, format="json"), Selector.of(EACH_INDEX), [table.TableColumn("first", (0,))], Limits(max_record_bytes=120))
    return schemas.select("doc_id", "fail.code", "fail.limit", "fail.path", "n_rows")


_LIMIT_RECORD = """
WITH l AS (SELECT l_orderkey, 16 + sum(16 + strlen(l_returnflag)) AS b FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey % 500 AS doc_id, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey) - 1 AS n, b FROM l),
f AS (SELECT doc_id, min(n) FILTER (b > 120) AS bad, count(*) AS every FROM r GROUP BY 1)
SELECT doc_id, CASE WHEN bad IS NOT NULL THEN 'RESOURCE_LIMIT_EXCEEDED' END AS code, CASE WHEN bad IS NOT NULL THEN 'max_record_bytes' END AS "limit",
    CASE WHEN bad IS NOT NULL THEN '[' || bad || ']' END AS path, coalesce(bad, every) AS n_rows FROM f"""


def limit_metadata(spark, d):
    schemas, _ = table.table(_order_nodes(spark, d), ROWS, table.Metadata(META), Limits(max_metadata_bytes=203))
    return _fails(schemas)


def limit_columns(spark, d):
    """Inferred tables whose first row has as many members as the customer's number modulo five, and one."""
    c = _read(spark, d, "customer")
    members = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 5).cast("int")), lambda i: F.concat(F.lit('"m'), i.cast("string"), F.lit('":1')))
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("[{"), F.array_join(members, ","), F.lit("}]")).alias("content"))
    schemas, _ = table.table(nodes(_spread(docs, c), format="json"), Selector.of(EACH_INDEX), "infer", Limits(max_columns=3))
    return _fails(schemas)


def limit_output(spark, d):
    _, rows = table.table(_order_nodes(spark, d), ROWS, [table.TableColumn("k", ("id",))])
    got = sinks.within(sinks.csv_lines(rows), Limits(max_output_bytes=40))
    return got.select("doc_id", "row_no", "line", "written", F.col("fail.limit").alias("limit_name"))


_LIMIT_OUTPUT = f"""
WITH r AS ({_ROWS_OF}), w AS (SELECT doc_id, n AS row_no, '"' || o_orderkey || '"' AS line, CAST(sum(strlen('' || o_orderkey) + 3) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS written, strlen('' || o_orderkey) + 3 AS own FROM r)
SELECT doc_id, row_no, CASE WHEN written <= 40 THEN line END AS line, written, CASE WHEN written > 40 THEN 'max_output_bytes' END AS limit_name FROM w WHERE written - own <= 40"""


def capture_metrics(spark, d):
    return route.metrics(route.route(_order_nodes(spark, d), [route.Capture("row", ROWS)]))


def capture_refused(spark, d):
    """Rows are taken until the fourth begins, which is refused."""
    specs = [route.Capture("row", ROWS, "observe"), route.Capture("all", Selector(), "observe")]
    got = route.route(_order_nodes(spark, d), specs, refuse=F.col("path") == ".rows[3]")
    return got.select("doc_id", "ord", "tag", "path", "fail.code")


_CAPTURE_REFUSED = f"""
WITH c AS ({_DOCS}), r AS ({_ROWS_OF})
SELECT doc_id, n - 1 AS ord, 'row' AS tag, '.rows[' || (n - 1) || ']' AS path, CASE WHEN n = 4 THEN 'ABORTED' END AS code FROM r WHERE n <= 4
UNION ALL SELECT doc_id, n, 'all', '.', NULL FROM c WHERE n < 4"""


def equal_values(spark, d):
    """The order documents against themselves, with one price changed, one number given its text, or one absent."""
    docs, case = _spread(order_documents(spark, d), _read(spark, d, "orders")), F.col("doc_id") % 4
    other = docs.where(case != 3).select(
        "doc_id",
        F.when(case == 1, F.regexp_replace("content", r'\{"id":', '{"id":1')).otherwise(F.col("content")).alias("content"),
        case.alias("case"),
    )
    a = nodes(docs, format="json")
    b = nodes(other, format="json").withColumn(
        "lexeme",
        F.when((F.col("doc_id") % 4 == 2) & (F.col("kind") == "number"), "").otherwise(F.col("lexeme")),
    )
    return values.equal(a, b)


def scan_stop(spark, d):
    """Running sums of a conversation's lengths, each delivered with its sign; an even one cuts its own operation."""
    c = _read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.sum(F.length("text")).alias("item"))
    got = scan.scan_emit(c, "conv_id", "turn", 0, lambda s, x: (s + x, ["even" if (s + x) % 2 == 0 else "odd", s + x]), lambda s: [], stop="even")
    return got.select("conv_id", "op", F.col("ord").alias("nth"), "out")


_SCAN_STOP = """
WITH t AS (SELECT conv_id, turn, sum(length(text)) AS n FROM conversations GROUP BY 1, 2),
s AS (SELECT conv_id, row_number() OVER w - 1 AS op, sum(n) OVER w AS s FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, op, CAST(0 AS BIGINT) AS nth, CASE WHEN s % 2 = 0 THEN 'even' ELSE 'odd' END AS out FROM s
UNION ALL SELECT conv_id, op, CAST(1 AS BIGINT), '' || CAST(s AS BIGINT) FROM s WHERE s % 2 = 1"""


def natural_order(spark, d):
    """Names with numbers at their end, in a map without order, and with one name placed first."""
    e = _read(spark, d, "events")
    held = e.groupBy("user_id").agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat("event_type", F.lit("~"), (F.col("event_id") % 12).cast("string")), F.lit(1)))).alias("m")
    )
    return held.select("user_id", F.array_join(natural_keys(F.col("m")), ",").alias("names"))


_NATURAL_ORDER = "SELECT user_id, string_agg(t || '~' || n, ',' ORDER BY t, n) AS names FROM (SELECT DISTINCT user_id, event_type AS t, event_id % 12 AS n FROM events) GROUP BY user_id"

#: name: (query, SQL)
ALL = {
    "tree_contract": (
        tree_contract,
        f"SELECT doc_id, CAST({_FAULT_AT} AS BIGINT) AS seq, CASE WHEN doc_id % 8 = 1 THEN 'DUPLICATE_MEMBER' ELSE 'STREAMABILITY_UNKNOWN' END AS code FROM ({_DOCS}) WHERE doc_id % 8 > 0",
    ),
    "protocol_errors": (
        protocol_errors,
        f"SELECT doc_id, CAST({_FAULT_AT} AS BIGINT) AS seq, 'PROTOCOL_ORDER_ERROR' AS code FROM ({_DOCS}) WHERE doc_id % 8 > 1",
    ),
    "duplicates_policies": (
        duplicates_policies,
        "SELECT o_orderkey AS doc_id, '{\"k\":' || o_custkey || ',\"in\":{\"p\":' || CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 1 END || '}}' AS text, 'last_wins' AS policy FROM orders "
        "UNION ALL SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"in\":{\"p\":1}}', 'first_wins' FROM orders",
    ),
    "duplicates_rejected": (
        duplicates_rejected,
        "SELECT o_orderkey AS doc_id, '.in' AS path, 'DUPLICATE_MEMBER' AS code FROM orders WHERE o_orderkey % 3 = 0",
    ),
    "overlap_matrix": (overlap_matrix, f"SELECT l_orderkey, l_linenumber, {_FIRST} AND (l_suppkey % 5 = 0 OR {_SECOND}) AS overlap FROM lineitem"),
    "number_text": (number_text, _NUMBER_TEXT),
    "lexeme_rule": (lexeme_rule, _LEXEME_RULE),
    "order_violation": (order_violation, f"SELECT doc_id, {_CODES} FROM ({_DOCS}) WHERE doc_id % 7 < 5"),
    "native_failures": (native_failures, f"SELECT doc_id, {_CODES} FROM ({_DOCS}) WHERE doc_id % 7 BETWEEN 1 AND 4"),
    "table_zero_rows": (
        table_zero_rows,
        f"SELECT doc_id, 'Identifier,Total' AS labels, CASE WHEN doc_id % 7 = 5 THEN 0 ELSE n END AS n_rows FROM ({_DOCS}) WHERE doc_id % 7 >= 5",
    ),
    "native_steps": (
        native_steps,
        f"SELECT r.doc_id, r.n - 1 AS row_no, o.o_orderstatus AS a, '' || r.o_orderkey AS b, '' || r.doc_id AS c, o.o_orderpriority AS d, CAST(NULL AS VARCHAR) AS e FROM ({_ROWS_OF}) AS r JOIN orders AS o USING (o_orderkey)",
    ),
    "table_infer_array": (
        table_infer_array,
        f"SELECT r.doc_id, r.n AS row_no, r.o_orderkey AS k, o.o_orderstatus AS status, '0,1' AS labels FROM ({_ROWS_OF}) AS r JOIN orders AS o USING (o_orderkey)",
    ),
    "table_infer_mixed": (table_infer_mixed, _INFER_MIXED),
    "limit_depth": (
        limit_depth,
        f"SELECT doc_id, 'RESOURCE_LIMIT_EXCEEDED' AS code, 'max_depth' AS \"limit\", '.meta[0].path' AS path FROM ({_DOCS})",
    ),
    "limit_key": (
        limit_key,
        "SELECT c_custkey AS doc_id, 'RESOURCE_LIMIT_EXCEEDED' AS code, 'max_key_bytes' AS \"limit\", '[0].\"' || repeat('é', CAST(c_custkey % 9 AS INTEGER)) || '\"' AS path FROM customer WHERE c_custkey % 9 > 4",
    ),
    "limit_record": (limit_record, _LIMIT_RECORD),
    "limit_metadata": (
        limit_metadata,
        f"SELECT doc_id, 'RESOURCE_LIMIT_EXCEEDED' AS code, 'max_metadata_bytes' AS \"limit\", '.meta' AS path FROM ({_DOCS})",
    ),
    "limit_columns": (
        limit_columns,
        "SELECT c_custkey AS doc_id, 'RESOURCE_LIMIT_EXCEEDED' AS code, 'max_columns' AS \"limit\", '[0]' AS path FROM customer WHERE c_custkey % 5 > 2",
    ),
    "limit_output": (limit_output, _LIMIT_OUTPUT),
    "capture_metrics": (
        capture_metrics,
        f"SELECT doc_id, n AS captures, 91 * n AS captured_bytes, CAST(91 AS BIGINT) AS captured_bytes_high FROM ({_DOCS})",
    ),
    "capture_refused": (capture_refused, _CAPTURE_REFUSED),
    "equal_values": (equal_values, f"SELECT doc_id, doc_id % 4 = 0 AS equal FROM ({_DOCS})"),
    "scan_stop": (scan_stop, _SCAN_STOP),
    "natural_order": (natural_order, _NATURAL_ORDER),
}
