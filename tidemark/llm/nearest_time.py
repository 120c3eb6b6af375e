"""Nearest record in time for the same entity within a tolerance.

Right-side times become disjoint intervals, bounded by the midpoints to their neighbours and by the tolerance: a left
time lies in the interval of its nearest record or in none. Intervals and left times are indexed by (entity, span of
time), so a hot entity is many small partitions; a right-side row within the tolerance of a span's edge is also put
into the span beyond it, which is all that span can need. In a span the intervals are sorted, and the range join is
one merge: the last interval that starts at or before a left time is the only one that can hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(right: DataFrame, tolerance: int, span: int) -> DataFrame:
    """Right rows ``k, t, id`` to ``k, span, start, end, id, t``, in doubled microseconds, both ends inclusive.
    Of records of the same time only the smallest id counts. Where two records are equally far from a midpoint, the
    midpoint belongs to the smaller id."""
    first, last = F.floor((F.col("t") - tolerance) / span), F.floor((F.col("t") + tolerance) / span)
    indexed = right.select("k", "t", "id", F.explode(F.sequence(first, last)).alias("span")).repartition("k", "span")
    times = indexed.groupBy("k", "span", "t").agg(F.min("id").alias("id"))
    order = W.partitionBy("k", "span").orderBy("t")
    near = times.select(
        "k", "span", "t", "id",
        F.lag("t").over(order).alias("t0"), F.lag("id").over(order).alias("id0"), F.lead("t").over(order).alias("t1"), F.lead("id").over(order).alias("id1"),
    )
    low = F.col("t0") + F.col("t") + F.when(F.col("id") < F.col("id0"), 0).otherwise(1)
    high = F.col("t1") + F.col("t") - F.when(F.col("id") < F.col("id1"), 0).otherwise(1)
    return near.select(
        "k", "span",
        F.greatest(F.coalesce(low, F.lit(-(2**62))), 2 * (F.col("t") - tolerance)).alias("start"),
        F.least(F.coalesce(high, F.lit(2**62)), 2 * (F.col("t") + tolerance)).alias("end"),
        "id", "t",
    )


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    left_entity: str,
    left_time: str,
    right_id: str,
    right_entity: str,
    right_time: str,
    tolerance_seconds: int = 1800,
    span_seconds: int = 7200,
) -> DataFrame:
    """``left_id, right_id, distance_us`` of the nearest right record of each left row, before or after it, at most
    the tolerance away (both ends count); equal distances go to the smallest right id. A record may serve several left
    rows, repeated left rows each get theirs, and rows with a null entity, time or id on either side have none. Other
    columns are ignored, whatever their names. ``span_seconds`` trades the copies at span edges against the size of a
    hot entity's partitions; it doesn't change the result."""
    us = lambda df, c: F.unix_micros(df[c].cast("timestamp")) if dict(df.dtypes)[c].startswith("timestamp") else df[c].cast("long")
    tolerance, span = tolerance_seconds * 1_000_000, span_seconds * 1_000_000
    r = right.select(right[right_entity].alias("k"), us(right, right_time).alias("t"), right[right_id].alias("id")).where("k is not null and t is not null and id is not null")
    l = left.select(left[left_entity].alias("k"), us(left, left_time).alias("t"), left[left_id].alias("left_id")).where("k is not null and t is not null")
    found = intervals(r, tolerance, span)
    kind_id, kind_left = dict(r.dtypes)["id"], dict(l.dtypes)["left_id"]
    record = F.struct(F.col("end"), "id", "t")
    rows = found.select("k", "span", F.col("start").alias("at"), F.lit(0).alias("side"), record.alias("record"), F.lit(None).cast(kind_left).alias("left_id")).unionByName(
        l.select("k", F.floor(F.col("t") / span).alias("span"), (2 * F.col("t")).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(f"struct<end:bigint,id:{kind_id},t:bigint>").alias("record"), "left_id")
    )
    merge = W.partitionBy("k", "span").orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("held", F.last("record", ignorenulls=True).over(merge)).where(F.col("side") == 1)
        .where(F.col("at") <= F.col("held.end"))
        .select("left_id", F.col("held.id").alias("right_id"), F.abs(F.shiftright("at", 1) - F.col("held.t")).alias("distance_us"))
    )

