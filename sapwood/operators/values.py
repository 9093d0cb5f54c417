"""Values of node tables: events, byte sizes, compact JSON text, equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.failures import NODE_BYTES, NUMBER_BYTES
from ..functions.paths import quoted_json
from ..sources import decode

CELL_TYPE = "struct<kind: string, bool: boolean, num: double, lexeme: string, str: string>"


def own_key(path: str = "path") -> Column:
    return F.try_element_at(F.col(path), F.lit(-1))["key"]


def let(value: Column, then) -> Column:
    """then(value) with value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(shown: Column) -> Column:
    """struct<digits, point> of a positive number's text: its digits without zeros at either end, and how many of
    them stand before the decimal point (negative: zeros behind the point)."""

    def parts(p):
        whole, both = p[0], F.concat(p[0], p[1])
        power = F.coalesce(F.when(p[2] != "", p[2].cast("int")), F.lit(0))
        kept = F.ltrim(both, F.lit("0"))
        return F.struct(F.rtrim(kept, F.lit("0")).alias("digits"), (F.length(whole) + power - F.length(both) + F.length(kept)).alias("point"))

    split = lambda t: F.array(*[F.regexp_extract(t, r"^([0-9]+)\.?([0-9]*)E?[+]?(-?[0-9]*)$", i) for i in (1, 2, 3)])
    return let(shown, lambda t: let(split(t), parts))


def _shorter(held: Column, size: Column) -> Column:
    """One digit less where that reads back too: the JVM's own text has now and then a digit or two too many."""
    form = F.concat(F.lit("%."), F.greatest(F.length(held["digits"]) - 2, F.lit(0)).cast("string"), F.lit("E"))
    tried = F.call_function("format_string", form, size)
    return let(tried, lambda t: F.when((F.length(held["digits"]) > 1) & (t.cast("double") == size), _digits(t)).otherwise(held))


def _long_text(held: Column) -> Column:
    digits, point = held["digits"], held["point"]
    zeros = lambda n: F.repeat(F.lit("0"), n)
    return (
        F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
        .when(point >= F.length(digits), F.concat(digits, zeros(point - F.length(digits))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )


def number_text(num: Column, lexeme: Column | None = None) -> Column:
    """The source text, else the shortest digits that read back, without an exponent; -0 stays; NaN and infinities are null's text."""

    def text(n):
        shown, size = n.cast("string"), F.abs(n)
        sign = F.when(F.startswith(shown, F.lit("-")), "-").otherwise("")
        long_ = let(
            _digits(size.cast("string")),
            lambda h: let(_shorter(h, size), lambda i: let(_shorter(i, size), lambda j: let(_shorter(j, size), _long_text))),
        )
        return (
            F.when(F.isnan(n) | (size == float("inf")), F.lit("null"))
            .when(n == 0, F.concat(sign, F.lit("0")))
            # two texts of 15 digits at most never read as one number, so such a text is the shortest
            .when(~F.contains(shown, F.lit("E")) & (F.length(shown) <= 16), F.regexp_replace(shown, r"\.0$", ""))
            .when(n.isNotNull(), F.concat(sign, long_))
        )

    # a double of ten millions is shown with an exponent already; whole numbers need none of the above
    whole = (F.abs(num) < 1e15) & (num != 0) & (F.rint(num) == num)
    out = F.when(whole, num.try_cast("bigint").cast("string")).otherwise(let(num, text))
    return out if lexeme is None else F.coalesce(lexeme, out)


def of_node(name: str) -> Column:
    """A field of a node table's row, and two that follow from its arrays: its own key and its parent's place."""
    if name == "key":
        return own_key()
    return F.try_element_at("ancestors", F.lit(-2)) if name == "parent" else F.col(name)


def node_bytes(root: Column, of=of_node) -> Column:
    """What one node adds to the size of a retained value; the value's root has no key."""
    key = F.when(root, F.lit(0)).otherwise(F.coalesce(F.octet_length(of("key")), F.lit(0)))
    number = F.coalesce(F.octet_length(of("lexeme")), F.lit(NUMBER_BYTES))
    payload = F.when(of("kind") == "string", F.octet_length(of("str"))).when(of("kind") == "number", number).otherwise(0)
    return (F.lit(NODE_BYTES) + key + payload).cast("long")


def _scalar_text(of, lexeme: Column | None = None) -> Column:
    kind = of("kind")
    return (
        F.when(kind == "null", "null")
        .when(kind == "bool", of("bool").cast("string"))
        .when(kind == "number", number_text(of("num"), lexeme))
        .otherwise(quoted_json(of("str")))
    )


def fragments(root: Column, of=of_node) -> Column:
    """What one node adds to its value's JSON text, each piece with its place: array<struct<a,b,c,text>>."""
    kind = of("kind")
    comma = F.when(of("pre") != of("parent") + 1, ",").otherwise("")
    lead = F.when(root, F.lit("")).otherwise(F.concat(comma, F.coalesce(F.concat(quoted_json(of("key")), F.lit(":")), F.lit(""))))
    opened = F.when(kind == "object", "{").when(kind == "array", "[").otherwise(_scalar_text(of, of("lexeme")))
    piece = lambda a, b, c, text: F.struct(
        a.cast("long").alias("a"),
        F.lit(b).alias("b"),
        c.cast("long").alias("c"),
        text.alias("text"),
    )
    head = piece(of("pre"), 0, F.lit(0), F.concat(lead, opened))
    tail = piece(of("last"), 1, -of("depth"), F.when(kind == "object", F.lit("}")).otherwise(F.lit("]")))
    return F.when(kind.isin("object", "array"), F.array(head, tail)).otherwise(F.array(head))


def joined(pieces: Column) -> Column:
    """The text of collected fragments."""
    return F.array_join(F.transform(F.sort_array(F.flatten(pieces)), lambda p: p["text"]), "")


def cell(row: str | None = None) -> Column:
    """The scalar fields of a node as a cell; a container's text is filled in by its reader."""
    c = lambda n: F.col(n if row is None else f"{row}.{n}")
    return F.struct(c("kind").alias("kind"), c("bool").alias("bool"), c("num").alias("num"), c("lexeme").alias("lexeme"), c("str").alias("str"))


def events(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The structural events of each document in order: key, seq, kind, key_name, bool, num, lexeme, str, depth.

    A member gives its key and then its value; a container gives a start and an end; each document
    ends with one ``end``. Documents that could not be read give none.
    """
    e = lambda a, b, c, kind, name=None: F.struct(
        a.cast("long").alias("a"),
        F.lit(b).alias("b"),
        c.cast("long").alias("c"),
        kind.alias("kind"),
        (F.lit(None).cast("string") if name is None else name).alias("key_name"),
    )
    k = F.col("kind")
    container = k.isin("object", "array")
    made = F.array_compact(
        F.array(
            F.when(own_key().isNotNull(), e(F.col("pre"), 0, F.lit(0), F.lit("key"), own_key())),
            e(F.col("pre"), 0, F.lit(1), F.when(container, F.concat(k, F.lit("_start"))).otherwise(k)),
            F.when(container, e(F.col("last"), 1, -F.col("depth"), F.concat(k, F.lit("_end")))),
            F.when(F.size("path") == 0, e(F.col("last"), 2, F.lit(0), F.lit("end"))),
        )
    )
    scalar = lambda n: F.when(F.col("e.kind").isin("bool", "number", "string", "null"), F.col(n)).alias(n)
    out = nodes.where("pre is not null").withColumn("e", F.explode(made))
    order = Window.partitionBy(key).orderBy("e.a", "e.b", "e.c")
    return out.select(
        key,
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.col("e.kind").alias("kind"),
        F.col("e.key_name").alias("key_name"),
        scalar("bool"),
        scalar("num"),
        scalar("lexeme"),
        scalar("str"),
        "depth",
    )


def equal(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, equal: whether the values of two node tables are the same in each document that is in either.

    Kinds, members in order, texts and numbers must agree; -0 is not 0, and a number with source text
    (an empty one too) equals only one with the same text. A document that only one table has is not equal.
    """

    def side(nodes, sign):
        number = F.struct(F.col("num").cast("string"), "lexeme")  # as text, or grouping would make -0 and 0 one
        return nodes.where("pre is not null").select(
            key,
            "pre",
            F.struct("path", "kind", "bool", number, "str").alias("what"),
            F.lit(sign).alias("side"),
        )

    both = side(a, 1).unionByName(side(b, -1))
    met = both.groupBy(key, "pre", "what").agg(F.sum("side").alias("over"))
    return met.groupBy(key).agg((F.max(F.abs("over")) == 0).alias("equal"))


#: Event classes; a key and the end are in none.
STARTS, ENDS, SCALARS = ("object_start", "array_start"), ("object_end", "array_end"), ("null", "bool", "number", "string")


def is_start(kind: Column) -> Column:
    return kind.isin(*STARTS)


def is_end(kind: Column) -> Column:
    return kind.isin(*ENDS)


def is_scalar(kind: Column) -> Column:
    return kind.isin(*SCALARS)


def byte_sizes(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, bytes: the size of each document's whole value as retained."""
    return nodes.where("pre is not null").groupBy(key).agg(F.sum(node_bytes(F.size("path") == 0)).alias("bytes"))


def json_text(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: each document's value as compact JSON, members in order."""
    return nodes.where("pre is not null").groupBy(key).agg(joined(F.collect_list(fragments(F.size("path") == 0))).alias("text"))


#: Characters above which a document's events are not held in one row; a JSON text has no more events than characters.
SHORT = decode.ROWS


def json_texts(docs: DataFrame, policies: list[str], key: str = "doc_id", content: str = "content") -> DataFrame:
    """key, text, policy: JSON documents as json_text gives them, under each policy of repeated members.

    Short documents stay in the row they came in and meet no exchange; the nodes of a long one leave the decoder in
    pieces and are brought together by its key.
    """
    marks = {"object_start": "{", "array_start": "[", "object_end": "}", "array_end": "]"}

    def text(e: Column) -> Column:
        shown = F.coalesce(*[F.when(e["kind"] == k, F.lit(m)) for k, m in marks.items()], _scalar_text(lambda name: e[name]))
        name = F.when(e["key_name"].isNull(), F.lit("")).otherwise(F.concat(quoted_json(e["key_name"]), F.lit(":")))
        return F.concat(F.when(e["later"], F.lit(",")).otherwise(""), name, shown)

    size = F.length(content)
    lists = decode.event_lists(docs.where(size <= SHORT), policies, key, content)
    out = lists.select(key, F.array_join(F.transform("events", text), "").alias("text"), "policy")
    for p in policies:
        long = decode.nodes(docs.where(size > SHORT), key, content, "json", duplicates=p)
        out = out.unionByName(json_text(long, key).withColumn("policy", F.lit(p)))
    return out


def is_json_number(text: Column) -> Column:
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def keeps_lexeme(text: Column, num: Column) -> Column:
    """A number keeps its source text only if that is a JSON number which reads as the value."""
    return F.coalesce(is_json_number(text) & (text.try_cast("double") == num), F.lit(False))
