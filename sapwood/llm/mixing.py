"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Each row has a uniform 64-bit hash. For a source whose target is ``q`` whole passes plus a
remainder, the rows whose hash lies below a threshold are taken ``q + 1`` times and the others
``q`` times. The threshold comes from histograms: words are summed by source and hash bucket,
the bucket in which the running sum crosses the remainder is found, and only that bucket is
split again, level by level. Nothing is sorted but the histogram of at most ``2**BITS`` rows
per source. Thresholds are nested: a larger target takes every row that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is taken more often than this.
MOST = 3.0
#: Hash bits of one histogram level, and levels. 3 x 12 bits leave one row in 2**36 at the boundary.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight).

    The total of all sizes is shared by weight; a source stops at ``most`` times its own size and
    its excess is shared again. That fixpoint is a water level: sources with cap <= level * weight are
    capped and the others get ``level * weight``. The level is raised by sums over the sources until no
    further one is capped. One row per source, however many; only the sums reach the driver.
    """
    cap = F.lit(most) * F.col("source_size")
    weight = F.col("weight").cast("double")
    every = sources.agg(F.sum("source_size").cast("double").alias("total"), F.sum(weight).alias("weights")).first()
    total, weights = every["total"] or 0.0, every["weights"] or 0.0
    level, capped = (total / weights if weights else 0.0), 0
    while True:
        full = sources.where(cap <= F.lit(level) * weight).agg(
            F.count("*").alias("n"),
            F.sum(cap).alias("spent"),
            F.sum(weight).alias("gone"),
        ).first()
        if full["n"] == capped or weights <= (full["gone"] or 0.0):
            break
        capped, level = full["n"], (total - full["spent"]) / (weights - full["gone"])
    if weights and full["n"] and weights <= full["gone"]:
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.least(cap, F.lit(level) * weight))


def default_weights(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh 5, 2, 1 and again.

    Sources are numbered in ranges: each range numbers its own, after the counts of the ranges before it.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(
        spark,
        sums.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()),
        "mix-sources",
    )
    before, offsets = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row for each range, not for each source
        offsets += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    offset = F.try_element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    by_rank = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    return ranged.withColumn("weight", by_rank).drop("_part")


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights=default_weights,
    key: str = "doc_id",
    most: float = MOST,
    carry: str | None = None,
) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, copies; with carry, a struct of that name with the row itself.

    docs needs the key, ``text`` and ``source``; other columns are ignored, whatever their names.
    Null or blank text: size 0. Null source: a source of its own. A row's hash is that of its key and text, so rows
    that repeat a key, or have none, are taken each by itself; rows that repeat both are taken alike. Empty table: empty result. A taken row is taken whole; a
    source's words differ from its target by half of one boundary row (a hash cell) at most.
    """
    sizes = docs.select(
        F.col(key).alias("_key"),
        F.col("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(77), F.col(key).cast("string"), F.col("text")).alias("_hash"),
        *([F.struct("*").alias("_carried")] if carry else []),
    )
    sizes = stored(spark, sizes, "mix-sizes")
    plan = targets(stored(spark, weights(sizes.drop("_carried")), "mix-weights"), most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_passes", passes).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    plan = stored(spark, plan, "mix-plan")

    unsigned = lambda shift: F.shiftrightunsigned(F.col("_hash"), shift)
    bound = plan.select("source", F.lit(0).cast("long").alias("_prefix"), F.col("_rest"))
    for level in range(1, LEVELS + 1):
        shift = 64 - BITS * level
        rows = sizes.drop("_carried").where("size > 0").withColumn("_bucket", unsigned(shift))
        if level > 1:  # only the boundary bucket is refined
            rows = rows.withColumn("_above", unsigned(shift + BITS)).join(
                small(bound.withColumnsRenamed({"source": "_s"})),
                F.col("source").eqNullSafe(F.col("_s")) & (F.col("_above") == F.col("_prefix")),
            )
        sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")).alias("h")
        sums = sums.join(small(bound.select(F.col("source").alias("_s"), "_rest")), F.col("source").eqNullSafe(F.col("_s")))
        till = Window.partitionBy("source").orderBy("_bucket")
        sums = sums.withColumn("_till", F.sum("_words").over(till)).withColumn("_before", F.col("_till") - F.col("_words"))
        # a remainder beyond the last bucket can only be rounding: that bucket is then the boundary
        sums = sums.withColumn("_last", F.lead("_bucket").over(till).isNull())
        bound = sums.where((F.col("_before") <= F.col("_rest")) & ((F.col("_till") > F.col("_rest")) | F.col("_last"))).select(
            "source",
            F.col("_bucket").alias("_prefix"),
            (F.col("_rest") - F.col("_before")).alias("_rest"),
            "_words",
        )
        bound = stored(spark, bound, f"mix-level{level}")
    # the last cell goes in if that brings the source nearer to its target
    edge = bound.select(
        F.col("source").alias("_s2"),
        (F.col("_prefix") + F.when(F.col("_rest") * 2 >= F.col("_words"), 1).otherwise(0)).alias("_below"),
    )
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_s2")), "left").select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        "_passes",
        F.coalesce("_below", F.lit(0)).alias("_below"),
    )
    shift = 64 - BITS * LEVELS
    out = sizes.join(small(plan), F.col("source").eqNullSafe(F.col("_s")))
    extra = F.when((F.col("size") > 0) & (unsigned(shift) < F.col("_below")) & (F.col("_passes") < F.lit(most)), 1).otherwise(0)
    copies = F.when(F.col("source_size") > 0, F.col("_passes") + extra).otherwise(0).cast("long")
    return out.select(
        F.col("_key").alias(key),
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        *([F.col("_carried").alias(carry)] if carry else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
