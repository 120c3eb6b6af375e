"""Policy-driven upserts, first-write-wins appends, re-keying and entity merges over immutable tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import latest_per_key

POLICIES = ("replace", "coalesce_new", "coalesce_old", "increment")


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the last written."""
    return latest_per_key(df, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], policies: Mapping[str, str]) -> DataFrame:
    """``old`` with the rows of ``new`` merged in, both unique by key. Columns by policy: ``replace`` takes the new
    value, null included; ``coalesce_new`` the new one unless null; ``coalesce_old`` the old one unless null;
    ``increment`` the sum, a missing side counting as nothing. Keys match null-safe."""
    if bad := set(policies.values()) - set(POLICIES):
        raise ValueError(f"unknown policies: {sorted(bad)}")
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in policies], F.lit(True).alias("_old"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in policies], F.lit(True).alias("_new"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    joined = o.join(n, on, "full_outer")

    def value(c: str, policy: str) -> Column:
        a, b = F.col(f"o_{c}"), F.col(f"n_{c}")
        if policy == "replace":
            return F.when(F.col("_new"), b).otherwise(a)
        if policy == "coalesce_new":
            return F.coalesce(b, a)
        if policy == "coalesce_old":
            return F.coalesce(a, b)
        return F.coalesce(a + b, a, b)

    return joined.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], *[value(c, p).alias(c) for c, p in policies.items()])


def append_first(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, of several the first; what was written stays."""
    return old.unionByName(latest_per_key(new, keys, order).join(old.select(*keys), list(keys), "left_anti"))


def rekey(df: DataFrame, mapping: DataFrame, columns: Sequence[str], old_id: str = "old_id", new_id: str = "new_id") -> DataFrame:
    """Replaces ids found in the mapping in every listed column."""
    out = df
    for i, c in enumerate(columns):
        m = mapping.select(F.col(old_id).alias(f"_old{i}"), F.col(new_id).alias(f"_new{i}"))
        out = out.join(m, F.col(c) == F.col(f"_old{i}"), "left").withColumn(c, F.coalesce(f"_new{i}", c)).drop(f"_old{i}", f"_new{i}")
    return out


def merge_entities(df: DataFrame, entity: str, natural: Sequence[str], attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entities of one natural key become the one of the smallest id; its attributes are the first non-null ones in
    order of id. Gives the merged entities and the mapping ``old_id, new_id`` of the others."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(entity)))
    merged = df.groupBy(*natural).agg(F.min(entity).alias(entity), *[first(c).alias(c) for c in attributes])
    mapping = df.join(merged.select(*natural, F.col(entity).alias("new_id")), list(natural)).where(F.col(entity) != F.col("new_id")).select(F.col(entity).alias("old_id"), "new_id")
    return merged, mapping
