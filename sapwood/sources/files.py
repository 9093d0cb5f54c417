"""Files as documents. Record-wise formats are split by Spark, so one large file is many tasks' work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import DECODERS, nodes

#: Formats by the ending of a file's name, where it is not the format's own name.
ENDINGS = {"ndjson": "jsonl", "yml": "yaml", "cfg": "ini", "svg": "xml"}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), content: every file is one document."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, content: every line that is not blank is one document; ids grow in file order but have gaps."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("content"))


def csv_records(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """One row per record under the header's names; all cells are text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline).option("escape", '"').csv(path)


def folder_nodes(spark: SparkSession, path: str, format: str | None = None, corrupt: str = "keep", **options) -> DataFrame:
    """The node table of a folder's files, each one document; the format is given or follows from each name's ending.

    corrupt says what becomes of a file that cannot be read or has an unknown ending: "keep" one row with its
    failure, "drop" it, or "fail" the query.
    """
    ending = F.lower(F.regexp_extract("doc_id", r"\.([A-Za-z0-9]+)$", 1))
    named = F.create_map(*[F.lit(x) for pair in (dict.fromkeys(DECODERS) | ENDINGS).items() for x in (pair[0], pair[1] or pair[0])])
    docs = documents(spark, path).withColumn("format", F.lit(format) if format else F.coalesce(F.try_element_at(named, ending), ending))
    held = nodes(docs, **options)
    if corrupt == "keep":
        return held
    if corrupt == "drop":
        return held.where("fail is null")
    told = F.concat_ws(": ", F.col("fail.code"), F.col("doc_id"), F.col("fail.message"))
    return held.where(F.when(F.col("fail").isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True))
