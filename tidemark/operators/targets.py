"""Targets from several observations: agreement, reasons, first events and the time from which they were known."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreed(rows: DataFrame, keys: Sequence[str], values: Sequence[str], others: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Keys whose whole observations all have the same ``values``, with them and the aggregates ``others``; and the keys
    that have several, as ``scores`` (different ones) and ``observations``. Distinct values are counted from one row
    each, so a key with many observations arrives as few. An observation with a null value says nothing."""
    whole = rows.where(" and ".join(f"{v} is not null" for v in values))
    known = whole.groupBy(*keys).agg(*[F.min(v).alias(v) for v in values], *[F.max(v).alias(f"_{v}") for v in values], *others)
    same = [F.col(v) == F.col(f"_{v}") for v in values]
    each = whole.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("n"))
    conflicts = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("scores"), F.sum("n").alias("observations")).where("scores > 1")
    return known.where(F.forall(F.array(*same), lambda x: x)).drop(*[f"_{v}" for v in values]), conflicts


def agreement(rows: DataFrame, keys: Sequence[str], valid: Column, values: Sequence[str]) -> DataFrame:
    """``artifacts, valid, scores, outcome`` of each key: first each artifact is checked for itself, then the different
    values of the good ones decide between ``target``, ``conflict`` and ``no_valid_artifact``."""
    each = rows.withColumn("_ok", F.coalesce(valid, F.lit(False))).groupBy(*keys, "_ok", *values).agg(F.count(F.lit(1)).alias("_n"))
    per = each.groupBy(*keys).agg(F.sum("_n").alias("artifacts"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n"))), F.lit(0)).alias("valid"), F.count_if("_ok").alias("scores"))
    return per.withColumn("outcome", F.when(F.col("valid") == 0, "no_valid_artifact").when(F.col("scores") > 1, "conflict").otherwise("target"))


def known_from(event: Column, retrieved: Column, delay: int, cutover: int) -> Column:
    """When a result was known: a ``delay`` after the event; of events from ``cutover`` on, whose retrieval was watched,
    not before the last retrieval."""
    return F.when(event >= cutover, F.greatest(event + delay, retrieved)).otherwise(event + delay)


def first_reason(reasons: Mapping[str, Column], otherwise: str = "kept") -> Column:
    """The first reason in order that holds; a null condition doesn't."""
    out = None
    for name, condition in reasons.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def first_events(events: DataFrame, keys: Sequence[str], minute: str, event_id: str, is_home: str) -> DataFrame:
    """``n, outcome, event_id`` of each key: all its events, and whose came first; both sides' in the first minute are
    ``tied``. One pass: the two sides' firsts are aggregated apart."""
    side = lambda home: F.min(F.when(F.col(is_home) == home, F.struct(minute, event_id)))
    per = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), side(True).alias("_h"), side(False).alias("_a"))
    h, a = F.col(f"_h.{minute}"), F.col(f"_a.{minute}")
    outcome = F.when(h == a, "tied").when(a.isNull() | (h < a), "home_first").otherwise("away_first")
    first = F.when(h == a, F.least(f"_h.{event_id}", f"_a.{event_id}")).when(a.isNull() | (h < a), F.col(f"_h.{event_id}")).otherwise(F.col(f"_a.{event_id}"))
    return per.select(*keys, "n", outcome.alias("outcome"), first.alias(event_id))


def complete_latest(rows: DataFrame, key: str, part: str, parts: Sequence[str], time: str, tie: str, value: str) -> DataFrame:
    """The latest ``value`` of each of the ``parts`` of a key, as columns that sum to one, for keys that have all of
    them; of one time the smaller ``tie``. One aggregation: a busy key arrives as one row a partition."""
    latest = lambda p: F.max(F.when(F.col(part) == p, F.struct(F.col(time), (-F.col(tie)).alias("t"), F.col(value).alias("v"))))["v"].alias(p)
    per = rows.groupBy(key).agg(*[latest(p) for p in parts]).where(" and ".join(f"{p} is not null" for p in parts))
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return per.select(key, *[(F.col(p) / total).alias(p) for p in parts])
