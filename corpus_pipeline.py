"""The corpus pipeline: quality filter, near-duplicate removal, secret redaction, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sapwood.llm import jaccard_join, mixing, packing, quality, secrets
from sapwood.llm.common import stored, table

#: Lowest quality score that stays.
QUALITY = 0.3

#: No SQL: trained rules, signatures, decoding and a tokenizer stand in the way.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rule score is at least QUALITY; a null text is scored as an empty one."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"), QUALITY, texts=table(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id. Ids repeated in a group: one row stays."""
    return jaccard_join.keep_one(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: none to three rows. A document without words is never taken."""
    taken = mixing.mix_sources(spark, docs, carry="row").where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(spark, docs)


STAGES = [("quality classifier", filter_quality), ("n-gram Jaccard join", drop_near_copies), ("secret scans", redact_secrets), ("mixing sources", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
