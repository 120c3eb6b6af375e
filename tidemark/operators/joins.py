"""Joins with conditions on their keys: lists, lookups that must succeed, bounded pairs of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.checks import CheckFailed


def in_keys(df: DataFrame, column: str, keys: Sequence[object]) -> DataFrame:
    """Rows whose ``column`` is one of the driver's ``keys``, by a semi-join with a table of them, however long the list;
    a null key matches nothing."""
    kind = df.schema[column].dataType
    listed = df.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys) if k is not None], f"`{column}` {kind.simpleString()}")
    return df.join(listed, column, "left_semi")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join on a table whose keys are unique; an error names a key that the table lacks or has twice."""
    twice = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    missing = df.join(table.select(*keys), list(keys), "left_anti").select(*keys).head(1)
    if twice or missing:
        raise CheckFailed(f"{'twice' if twice else 'missing'}: {(twice or missing)[0].asDict()}")
    return df.join(table, list(keys))


def bounded_pair(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, start: str, end: str) -> DataFrame:
    """Left rows with ``start <= time < end`` joined to the one right row of their keys; keys that the right side has
    more than once join nothing."""
    values = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in values]).where("_n = 1").drop("_n")
    return left.where((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp"))).join(one, list(keys))
