"""Fail-closed assertions, rule unions and comparisons of states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A dataset broke an invariant."""


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error naming one key that occurs twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if twice:
        raise CheckFailed(f"not unique: {twice[0].asDict()}")
    return df


def assert_simplex(df: DataFrame, keys: Sequence[str], probability: str, tolerance: float = 1e-9) -> DataFrame:
    """``df``, or an error where the probabilities of a key are negative, not finite or don't sum to one."""
    sums = df.groupBy(*keys).agg(F.sum(probability).alias("s"), F.min(probability).alias("lo"), F.bool_and(F.col(probability).isNotNull() & ~F.isnan(probability)).alias("ok"))
    bad = sums.where(~F.col("ok") | (F.col("lo") < 0) | (F.abs(F.col("s") - 1) > tolerance)).head(1)
    if bad:
        raise CheckFailed(f"no distribution: {bad[0].asDict()}")
    return df


def assert_before(df: DataFrame, time: str, boundary: object) -> DataFrame:
    """``df``, or an error if any row is at or after a boundary it must not see."""
    if df.where(F.col(time) >= F.lit(boundary)).head(1):
        raise CheckFailed(f"{time} reaches {boundary}")
    return df


def issues(rules: Mapping[str, tuple[str, str, DataFrame]]) -> DataFrame:
    """All findings of named rules: ``rule, severity, entity_type, entity_id``. A rule is its severity, the kind of
    entity and a frame whose first column is the entity's id."""
    out = None
    for rule, (severity, kind, df) in rules.items():
        part = df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(kind).alias("entity_type"), F.col(df.columns[0]).cast("string").alias("entity_id"))
        out = part if out is None else out.unionByName(part)
    return out


def transitions(before: DataFrame, now: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Keys that were ``opened``, ``resolved`` or ``updated`` between two states; null is a state."""
    b = before.select(*keys, F.col(state).alias("_b"), F.lit(True).alias("_was"))
    n = now.select(*keys, F.col(state).alias("_n"), F.lit(True).alias("_is"))
    kind = F.when(F.col("_was").isNull(), "opened").when(F.col("_is").isNull(), "resolved").when(~F.col("_b").eqNullSafe(F.col("_n")), "updated")
    return b.join(n, list(keys), "full_outer").select(*keys, kind.alias("transition")).where("transition is not null")


def markdown(df: DataFrame, titles: Mapping[str, str]) -> list[str]:
    """A small table, such as a report of aggregates, as lines of Markdown, in its order."""
    rows = df.select(*titles).collect()
    return [f"| {' | '.join(titles.values())} |", "|-" * len(titles) + "|", *(f"| {' | '.join('' if x is None else str(x) for x in r)} |" for r in rows)]


def lifecycle(rows: DataFrame, delivery: str, entity: str, rules: Mapping[str, Column]) -> DataFrame:
    """``rule, entity, delivery, event``: issues that named conditions find in successive deliveries. One is ``opened``
    where it is first found, ``resolved`` at the next delivery without it and ``reopened`` when it comes back.
    Deliveries are numbered from 1 in order; one scan evaluates all rules."""
    order = rows.select(delivery).distinct().withColumn("_i", F.row_number().over(W.orderBy(delivery)))  # one row a delivery
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    hits = rows.select(delivery, entity, F.explode(found).alias("rule")).distinct().join(order, delivery)
    w = W.partitionBy("rule", entity).orderBy("_i")
    placed = hits.withColumn("_before", F.lag("_i").over(w)).withColumn("_after", F.lead("_i").over(w)).join(order.agg(F.max("_i").alias("_last")), F.lit(True))
    events = F.array(
        F.when(F.col("_before").isNull(), F.struct(F.col("_i").alias("delivery"), F.lit("opened").alias("event"))).when(F.col("_before") < F.col("_i") - 1, F.struct(F.col("_i").alias("delivery"), F.lit("reopened").alias("event"))),
        F.when((F.col("_after").isNull() | (F.col("_after") > F.col("_i") + 1)) & (F.col("_i") < F.col("_last")), F.struct((F.col("_i") + 1).alias("delivery"), F.lit("resolved").alias("event"))),
    )
    return placed.select("rule", entity, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_e")).select("rule", entity, F.col("_e.delivery").cast("long").alias("delivery"), "_e.event")


def reconciled(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """All keys of both sides with ``verdict``: ``missing``, ``unexpected``, ``value_differs`` by more than the
    tolerance, or ``agrees``; other columns of ``actual`` are kept."""
    e, a = expected.select(*keys, F.col(value).alias("_e"), F.lit(True).alias("_was")), actual.withColumnRenamed(value, "_a").withColumn("_is", F.lit(True))
    verdict = F.when(F.col("_is").isNull(), "missing").when(F.col("_was").isNull(), "unexpected").when(F.abs(F.col("_a") - F.col("_e")) > tolerance, "value_differs").otherwise("agrees")
    return e.join(a, list(keys), "full_outer").withColumn("verdict", verdict).drop("_e", "_a", "_was", "_is")
