"""Attributes as known at event time, with hot entities sharded by time.

All rows make up ``SPREAD`` shards' worth for every shuffle partition. An entity with more rows than one shard is cut
into spans of about as many rows each, at quantiles of its times, so that each (entity, span) is a small part of a
task. A span starts out not knowing what came before it; the last version of all earlier spans is therefore replicated
into it as a carry-in, found from one row per (entity, span). After that every span is merged on its own and the
result is the same as for an uncut entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPREAD = 4


def _micros(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(name).cast("long")


def known_before(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str,
    event_entity: str,
    event_time: str,
    version_entity: str,
    version_time: str,
    version_id: str,
    version_kind: str,
    kinds: Sequence[str],
    shard_rows: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """For every event and kind, the id of the entity's latest version before the event.

    Gives ``event_id, attribute_kind, known_row_id, known_at`` (microseconds), one row per event and kind for which
    something was known. ``strict`` asks for versions before the event's time, else up to it. Of versions of the same
    time the smallest id counts. Rows with a null entity, time or id take no part: an event without a time or entity
    knows nothing, a version of unknown time is never known. Repeated events each get their rows. Other columns of
    the inputs are ignored, so clashing names don't matter. Empty inputs give no rows. ``shard_rows`` is the size of a
    shard, by default all rows divided by ``SPREAD`` times the shuffle partitions."""
    e = events.select(F.col(event_entity).alias("k"), _micros(events, event_time).alias("t"), F.col(event_id).alias("event_id")).where("k is not null and t is not null")
    v = (
        versions.select(F.col(version_entity).alias("k"), _micros(versions, version_time).alias("t"), F.col(version_kind).alias("kind"), F.col(version_id).alias("id"))
        .where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("id").isNotNull() & F.col("kind").isin(*kinds))
        .groupBy("k", "t", "kind")
        .agg(F.min("id").alias("id"))
    )
    no_id = F.lit(None).cast(dict(v.dtypes)["id"])
    no_event = F.lit(None).cast(dict(e.dtypes)["event_id"])
    shards = SPREAD * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = e.select("k", "t").unionAll(v.select("k", "t"))
    counts = times.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # entities beyond one shard: with the default size fewer than ``shards``, and as few cuts in all of them together
    size = counts.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / shards)).cast("long").alias("size")) if shard_rows is None else None
    large = (counts.crossJoin(F.broadcast(size)) if shard_rows is None else counts.withColumn("size", F.lit(shard_rows))).where("n > size").select("k", F.ceil(F.col("n") / F.col("size")).cast("int").alias("parts"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("at", F.floor(i * shards / F.col("parts")).cast("int"))))
    hot = (
        times.join(F.broadcast(large), "k").groupBy("k", "parts").agg(F.percentile_approx("t", [i / shards for i in range(shards)], 4 * shards).alias("at"))
        .select("k", cuts.alias("cuts"))
    )
    hot = F.broadcast(hot) if shard_rows is None else hot
    late = 1 if strict else 0
    rows = (
        e.select("k", "t", F.lit(1 - late).alias("side"), "event_id", F.lit(None).cast("string").alias("kind"), no_id.alias("id"))
        .unionAll(v.select("k", "t", F.lit(late).alias("side"), no_event.alias("event_id"), "kind", "id"))
        .join(hot, "k", "left")
        .withColumn("shard", F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda x: x <= F.col("t")))).otherwise(0))
        .drop("cuts")
    )
    known = lambda x: F.when(F.col("kind") == x, F.struct("t", "id"))
    per_shard = rows.where(F.col("k").isNotNull()).join(hot.select("k"), "k", "left_semi").groupBy("k", "shard").agg(
        # the latest version of a shard; its time is unique within (entity, kind)
        *[F.max_by(F.struct("t", "id"), F.when(F.col("kind") == x, F.col("t"))).alias(f"v{i}") for i, x in enumerate(kinds)],
        *[F.max(F.when(F.col("kind") == x, F.col("t"))).alias(f"t{i}") for i, x in enumerate(kinds)],
    )
    before = W.partitionBy("k").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_shard.select("k", "shard", *[F.last(F.when(F.col(f"t{i}").isNotNull(), F.col(f"v{i}")), ignorenulls=True).over(before).alias(f"c{i}") for i in range(len(kinds))])
        .select("k", "shard", F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(f"c{i}").alias("v")) for i, x in enumerate(kinds)])).alias("c"))
        .where("c.v is not null")
    )
    carry = carried.select("k", F.col("c.v.t").alias("t"), F.lit(late).alias("side"), no_event.alias("event_id"), F.col("c.kind").alias("kind"), F.col("c.v.id").alias("id"), "shard")
    merge = W.partitionBy("k", "shard").orderBy("t", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = rows.unionByName(carry).select(
        "event_id", F.col("kind").isNull().alias("is_event"), *[F.last(known(x), ignorenulls=True).over(merge).alias(f"v{i}") for i, x in enumerate(kinds)]
    )
    facts = F.array(*[F.struct(F.lit(x).alias("kind"), F.col(f"v{i}").alias("v")) for i, x in enumerate(kinds)])
    return (
        merged.where("is_event").select("event_id", F.explode(facts).alias("f")).where("f.v is not null")
        .select("event_id", F.col("f.kind").alias("attribute_kind"), F.col("f.v.id").alias("known_row_id"), F.col("f.v.t").alias("known_at"))
    )


def team_versions(performance: DataFrame, targets: DataFrame) -> DataFrame:
    """``team, known_from, kind, row_id`` of both fact tables, a row for each side of a match."""
    side = lambda df, row, at, kind: df.select(
        F.explode(F.array("home_team_id", "away_team_id")).alias("team"), F.col(at).alias("known_from"), F.lit(kind).alias("kind"), F.col(row).alias("row_id")
    )
    return side(performance, "performance_id", "available_at", "performance").unionByName(side(targets, "target_row_id", "result_available_at", "result"))
