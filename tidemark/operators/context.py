"""What was known of an entity before an event, beyond its latest value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join


def recent_form(rows: DataFrame, entity: str, event: str, time: str, known: str, scored: str, conceded: str, last: int) -> DataFrame:
    """``event, entity, played, points, scored, conceded, form`` over those ``last`` results of the entity that became
    known last before the event's time; no row where none was. Each result carries the last ones up to itself, a list
    of bounded length, and events look up the latest result before them, so there are no pairs of events."""
    upto = W.partitionBy(entity).orderBy(known, time, event).rowsBetween(1 - last, W.currentRow)
    told = rows.select(entity, known, F.col(time).alias("_k"), F.col(event).alias("_e"), F.reverse(F.collect_list(F.struct(F.col(scored).alias("s"), F.col(conceded).alias("c"))).over(upto)).alias("_form"))
    found = asof_join(rows.select(entity, time, event), told, [entity], time, known, ["_form"], inclusive=False, tie=["_k", "_e"]).where("_form is not null")
    points = lambda x: F.when(x["s"] > x["c"], 3).when(x["s"] == x["c"], 1).otherwise(0)
    letter = lambda x: F.when(x["s"] > x["c"], "W").when(x["s"] == x["c"], "D").otherwise("L")
    total = lambda f: F.aggregate("_form", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return found.select(event, entity, F.size("_form").cast("long").alias("played"), total(points).alias("points"), total(lambda x: x["s"]).alias("scored"), total(lambda x: x["c"]).alias("conceded"), F.array_join(F.transform("_form", letter), "").alias("form"))


def in_spans(rows: DataFrame, time: str, reach: int) -> DataFrame:
    """``rows`` with ``_span``, the number of a span of ``reach`` time units, each row once more in the span after its own,
    as ``_copy``. A window over an entity's span then sees all that lies up to ``reach`` back, however busy the entity."""
    span = F.floor(F.col(time) / reach)
    place = F.array(F.struct(span.alias("n"), F.lit(False).alias("c")), F.struct((span + 1).alias("n"), F.lit(True).alias("c")))
    return rows.select("*", F.explode(place).alias("_p")).select(*rows.columns, F.col("_p.n").alias("_span"), F.col("_p.c").alias("_copy"))


def looking_back(rows: DataFrame, entity: Sequence[str], time: str, found: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """``rows`` with columns aggregated over the entity's rows in ``[time - width, time)``: ``name: (aggregate, width)``.
    Windows run over spans of the greatest width."""
    spans = in_spans(rows, time, max(w for _, w in found.values()))
    over = lambda w: W.partitionBy(*entity, "_span").orderBy(time).rangeBetween(-w, -1)
    return spans.select("*", *[c.over(over(w)).alias(n) for n, (c, w) in found.items()]).where("not _copy").drop("_span", "_copy")


def running_before(rows: DataFrame, entity: Sequence[str], time: str, sums: Mapping[str, Column], span: int) -> DataFrame:
    """``rows`` with sums over all of the entity's rows at strictly earlier times, 0 where there are none. Each span adds
    up on its own; what the spans before it come to is carried in, from one row a span."""
    placed = rows.withColumn("_span", F.floor(F.col(time) / span)).withColumns({f"_v_{n}": c for n, c in sums.items()})
    per = placed.groupBy(*entity, "_span").agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums])
    earlier = W.partitionBy(*entity).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(*entity, "_span", *[F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums])
    inside = W.partitionBy(*entity, "_span").orderBy(time).rangeBetween(W.unboundedPreceding, -1)
    joined = placed.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums]).join(carried, [*entity, "_span"])
    return joined.select(*rows.columns, *[(F.col(f"_c_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def last_before(rows: DataFrame, entity: Sequence[str], time: str, span: int) -> DataFrame:
    """``rows`` with ``last``, the entity's latest strictly earlier time, null where there is none; by spans, with the
    latest time of all spans before carried in."""
    placed = rows.withColumn("_span", F.floor(F.col(time) / span))
    earlier = W.partitionBy(*entity).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = placed.groupBy(*entity, "_span").agg(F.max(time).alias("_m")).select(*entity, "_span", F.max("_m").over(earlier).alias("_c"))
    inside = W.partitionBy(*entity, "_span").orderBy(time).rangeBetween(W.unboundedPreceding, -1)
    return placed.withColumn("_i", F.max(time).over(inside)).join(carried, [*entity, "_span"]).select(*rows.columns, F.coalesce("_i", "_c").alias("last"))
