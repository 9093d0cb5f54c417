"""Connected components of a link table, and of a small block of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Large-star and small-star rounds over (larger, smaller) pairs: each round ends as a written
    table. No round makes more pairs than it had. Minima are pre-aggregated and stored, so that a
    hub's pairs meet them in a plain join, which adaptive execution splits.
    """
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = stored(spark, e, "links")
    state = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        lows = stored(spark, lows, "links-lows")
        large = both.where("v > u").join(lows, F.col("u") == F.col("k")).select(
            F.col("v").alias("a"),
            F.col("m").alias("b"),
        ).where("a > b").distinct()
        large = stored(spark, large, "links-large")
        least = stored(spark, large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "links-lows")
        joined = large.join(least, F.col("a") == F.col("k"))
        small = joined.select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")
        ).select("p.a", "p.b").where("a > b").distinct()
        old, e = e, stored(spark, small, "links")
        for t in (old, lows, large, least):
            drop_stored(spark, t)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 of one block with links (i, j): the smallest node that each reaches."""
    root = np.arange(n)
    if not len(i):
        return root
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
