"""Latest, as-of, band and nearest joins. All are null-safe on their keys in the sense that a null key joins nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: int = 1) -> DataFrame:
    """The first ``rank`` rows of every key in the given order; the planner keeps only those before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rank).drop("_rn")


def asof_join(
    probes: DataFrame,
    builds: DataFrame,
    key: Sequence[str],
    probe_time: str,
    build_time: str,
    values: Sequence[str],
    *,
    inclusive: bool = True,
    tie: Sequence[str] = (),
    lookback: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """Each probe with the ``values`` of the latest build at or (not ``inclusive``) before its time, null where there is
    none or it is older than ``lookback``. One union, one shuffle and one sorted pass, no pairs. Of builds of one time
    the last in the order of ``tie`` counts. Keys with very many rows are split into spans of ``span`` time units, the
    last build of all earlier spans being carried into each; the result is the same."""
    carried = [c for c in probes.columns if c not in key and c != probe_time]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    record = F.struct(F.col(build_time).alias("_t"), *values)
    empty = F.lit(None).cast(builds.select(record.alias("r")).schema["r"].dataType)
    tag_probe, tag_build = (1, 0) if inclusive else (0, 1)
    rows = probes.select(*key, F.col(probe_time).alias("_at"), F.lit(tag_probe).alias("_tag"), empty.alias("_r"), *carried, *[none(builds, c).alias(f"_k_{c}") for c in tie]).unionByName(
        builds.select(*key, F.col(build_time).alias("_at"), F.lit(tag_build).alias("_tag"), record.alias("_r"), *[none(probes, c).alias(c) for c in carried], *[F.col(c).alias(f"_k_{c}") for c in tie])
    )
    inside: list[str] = []
    if span is not None:
        rows, inside = rows.withColumn("_span", F.floor(F.col("_at") / span)), ["_span"]
        order = F.struct("_at", "_tag", *[f"_k_{c}" for c in tie])
        ends = rows.groupBy(*key, "_span").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), order)).alias("_last"))
        earlier = W.partitionBy(*key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
        brought = ends.select(*key, "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_r")).where("_r is not null")
        nothing = [c for c in rows.columns if c not in (*key, "_span", "_r", "_at", "_tag")]
        rows = rows.unionByName(brought.select(*key, "_span", "_r", (F.col("_span") * span).cast(rows.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_tag"), *[none(rows, c).alias(c) for c in nothing]))
    w = W.partitionBy(*key, *inside).orderBy("_at", "_tag", *[f"_k_{c}" for c in tie]).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("_held", F.last("_r", ignorenulls=True).over(w)).where(F.col("_tag") == tag_probe)
    if lookback is not None:
        found = found.withColumn("_held", F.when(F.col("_at") - F.col("_held._t") <= lookback, F.col("_held")))
    return found.select(*key, F.col("_at").alias(probe_time), *carried, *[F.col(f"_held.{v}").alias(v) for v in values])


def band_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, before: int, after: int) -> DataFrame:
    """Pairs with ``-before <= right_time - left_time <= after`` for the same key: an equi-join on time bins of the
    band's width, two or three bins a left row, then the exact condition. The right columns get the prefix ``r_``."""
    width = before + after + 1
    lo, hi = F.floor((F.col(left_time) - before) / width), F.floor((F.col(left_time) + after) / width)
    l = left.withColumn("_bin", F.explode(F.sequence(lo, hi)))
    r = right.select(*[F.col(c).alias(c if c in key else f"r_{c}") for c in right.columns]).withColumn("_bin", F.floor(F.col(f"r_{right_time}") / width))
    delta = F.col(f"r_{right_time}") - F.col(left_time)
    return l.join(r, [*key, "_bin"]).where((delta >= -before) & (delta <= after)).drop("_bin")


def nearest_with_margin(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, left_time: str, right_id: str, right_time: str, tolerance: int, margin: int) -> DataFrame:
    """``left_id, right_id, distance, ambiguous``: the nearest right row within the tolerance; ambiguous where the next
    nearest is less than ``margin`` farther. Equal distances go to the smaller right id."""
    pairs = band_join(left, right, key, left_time, right_time, tolerance, tolerance).withColumn("distance", F.abs(F.col(f"r_{right_time}") - F.col(left_time)))
    w = W.partitionBy(left_id).orderBy("distance", f"r_{right_id}")
    ranked = pairs.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w)).where("_rn = 1")
    return ranked.select(left_id, F.col(f"r_{right_id}").alias(right_id), "distance", F.coalesce(F.col("_next") - F.col("distance") < margin, F.lit(False)).alias("ambiguous"))


def no_event_between(rows: DataFrame, entity: str, start: str, end: str, own: str, events: DataFrame, event_time: str, event_id: str) -> DataFrame:
    """Rows whose entity has no other event in ``[start, end)``: the next event of the entity at or after ``start`` is
    found by one as-of pass over negated times, so a busy entity makes no pairs."""
    other = events.select(F.col(entity), (-F.col(event_time)).alias("_t"), F.col(event_id).alias("_next"), F.col(event_time).alias("_next_at"))
    probes = rows.withColumn("_p", -F.col(start))
    found = asof_join(probes, other, [entity], "_p", "_t", ["_next", "_next_at"], tie=["_next"])
    return found.where(F.col("_next_at").isNull() | (F.col("_next_at") >= F.col(end)) | (F.col("_next") == F.col(own))).drop("_p", "_next", "_next_at")
