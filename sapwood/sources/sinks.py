"""Tables as CSV and JSON texts, by the documented policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.failures import FAIL_TYPE, Limits, exceeded
from ..operators.values import number_text


def cell_text(cell: Column, missing: str | None = "") -> Column:
    """A cell as text: null is empty; a missing cell is the given text, or with None fails the query."""
    absent = F.raise_error(F.lit("MISSING_VALUE: a cell is missing")).cast("string") if missing is None else F.lit(missing)
    kind = cell["kind"]
    return F.when(kind == "missing", absent).when(kind == "null", "").when(kind == "bool", cell["bool"].cast("string")).when(
        kind == "number",
        number_text(cell["num"], cell["lexeme"]),
    ).otherwise(cell["str"])


def csv_lines(rows: DataFrame, key: str = "doc_id", missing: str | None = "") -> DataFrame:
    """key, row_no, line: always quoted, quotes doubled."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(cell_text(c, missing), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.select(key, "row_no", F.array_join(F.transform("cells", quote), ",").alias("line"))


def within(lines: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "line", newline: int = 1) -> DataFrame:
    """lines with ``written`` (bytes of a document's text up to and with this line) and ``fail``, up to the first line
    that goes beyond max_output_bytes; that line has the failure and no text."""
    done = F.sum(F.octet_length(text) + newline).over(Window.partitionBy(key).orderBy("row_no"))
    out = lines.withColumn("written", done)
    if limits.max_output_bytes is None:
        return out.withColumn("fail", F.lit(None).cast(FAIL_TYPE))
    over = F.col("written") > limits.max_output_bytes
    out = out.where(~over | (F.col("written") - F.octet_length(text) - newline <= limits.max_output_bytes))
    fail = F.when(over, exceeded("max_output_bytes", limits.max_output_bytes)).cast(FAIL_TYPE)
    return out.withColumn("fail", fail).withColumn(text, F.when(~over, F.col(text)))


def write_csv(rows: DataFrame, labels: list[str], path: str, missing: str | None = "") -> None:
    """Many-file CSV with a header, every field quoted, CRLF; a table without columns is refused."""
    if not labels:
        raise ValueError("OUTPUT_FAILED: a table without columns")
    named = rows.select(*[cell_text(F.get("cells", F.lit(i)), missing).alias(f"c{i}") for i in range(len(labels))])
    named.toDF(*labels).write.option("quoteAll", True).option("escape", '"').option("emptyValue", '""').option("header", True).option("lineSep", "\r\n").csv(path)


def records(rows: DataFrame, schemas: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, row_no, record: one JSON object per row, a missing cell's member left out, the last of equal labels kept.
    The labels are the rows' own, if they are not taken from schemas."""
    named = rows if schemas is None else rows.drop("labels").join(schemas.select(F.col(key).alias("_k"), "labels"), F.col(key) == F.col("_k"))
    value = lambda c: F.when(c["kind"] == "null", "null").when(c["kind"] == "bool", c["bool"].cast("string")).when(c["kind"] == "number", number_text(c["num"], c["lexeme"])).otherwise(
        F.regexp_replace(F.to_json(F.array(c["str"])), r"^\[|\]$", "")
    )
    label = lambda l: F.regexp_replace(F.to_json(F.array(l)), r"^\[|\]$", "")  # noqa: E731, E741
    pairs = F.filter(F.arrays_zip(F.col("labels").alias("l"), F.col("cells").alias("c")), lambda p: p["c"]["kind"] != "missing")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["l"] == p["l"]))
    return named.select(
        key,
        "row_no",
        F.concat(
            F.lit("{"),
            F.array_join(F.transform(last, lambda p: F.concat(label(p["l"]), F.lit(":"), value(p["c"]))), ","),
            F.lit("}"),
        ).alias("record"),
    )
