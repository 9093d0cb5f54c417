"""Checks of replayed event streams: the tree contract and the event protocol.

An events table has key, seq, kind, key_name. Levels are running sums, an event's container is the
latest start on the level above, so both checks are windows over one document's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .values import ENDS, STARTS


def placed(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """events with level (containers around the event), container (seq of the innermost open start), inside
    (its kind), nth (place among its container's events), before (the kind just before it there), just (the kind
    just before it in the document)."""
    step = F.when(F.col("kind").isin(*STARTS), 1).when(F.col("kind").isin(*ENDS), -1).otherwise(0)
    order = Window.partitionBy(key).orderBy("seq")
    e = events.where("kind is not null").withColumns({"_after": F.sum(step).over(order), "just": F.lag("kind").over(order)})
    # a start stands on its own level and once more, as the opener of what follows, on the level inside it
    place = lambda opens: F.struct(
        (F.col("_after") - F.when((step > 0) & F.lit(not opens), 1).otherwise(0)).alias("level"),
        F.lit(opens).alias("opens"),
    )
    both = e.withColumn("_at", F.explode(F.when(step > 0, F.array(place(False), place(True))).otherwise(F.array(place(False)))))
    opens, nth = F.col("_at.opens"), F.row_number()
    # on one level a container's events follow its opener, so one order serves all that is asked
    on_level = Window.partitionBy(key, "_at.level").orderBy("seq", "_at.opens")
    both = both.withColumns({
        "_nth": nth.over(on_level),
        "before": F.lag(F.when(~opens, F.col("kind"))).over(on_level),
        "_in": F.last(F.when(opens, F.struct("seq", "kind")), True).over(on_level),
    })
    both = both.withColumn("_from", F.coalesce(F.last(F.when(opens, F.col("_nth")), True).over(on_level), F.lit(0)))
    return both.where(~opens).select(
        key,
        "seq",
        F.col("_at.level").alias("level"),
        "kind",
        "key_name",
        F.col("_in.seq").alias("container"),
        F.col("_in.kind").alias("inside"),
        "before",
        (F.col("_nth") - F.col("_from")).alias("nth"),
        "just",
    )


def _malformed() -> Column:
    """Whether a placed event breaks the rules, whatever the names of members."""
    kind, before, just = F.col("kind"), F.col("before"), F.coalesce("just", F.lit(""))
    value = ~kind.isin("key", "end", *ENDS)
    in_object = F.coalesce(F.col("inside") == "object_start", F.lit(False))
    # the event before a close on its own level is the start that it closes
    opened = F.when(kind == "object_end", "object_start").otherwise("array_start")
    return (
        (value & in_object & (just != "key"))
        | (~value & (just == "key"))
        | ((kind == "key") & ~in_object)
        | (kind.isin(*ENDS) & ((F.col("level") < 0) | ~F.coalesce(before == opened, F.lit(False))))
        | (value & (F.col("level") == 0) & before.isNotNull())
        | ((kind == "end") & ((F.col("level") != 0) | before.isNull()))
        | (just == "end")
    )


def tree_contract(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seq, code of each document's first breach: DUPLICATE_MEMBER for a key twice in one object,
    STREAMABILITY_UNKNOWN for a value where a key is due, a key outside an object or without a value, a close
    with nothing open or of another kind, a second root value, an end before the root value is whole, a second end."""
    p = placed(events, key)
    p = p.withColumn("malformed", _malformed()).where(F.col("malformed") | (F.col("kind") == "key"))
    again = F.row_number().over(Window.partitionBy(key, "container", "level", "kind", "key_name").orderBy("seq")) > 1
    code = F.when(F.col("malformed"), "STREAMABILITY_UNKNOWN").when((F.col("kind") == "key") & again, "DUPLICATE_MEMBER")
    bad = p.withColumn("code", code).where("code is not null")
    return bad.groupBy(key).agg(F.min("seq").alias("seq"), F.min_by("code", "seq").alias("code"))


def protocol_errors(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seq, code (PROTOCOL_ORDER_ERROR) of each document's first malformed event; repeats of a key are no matter here."""
    p = placed(events, key)
    return p.where(_malformed()).groupBy(key).agg(F.min("seq").alias("seq")).select(key, "seq", F.lit("PROTOCOL_ORDER_ERROR").alias("code"))
