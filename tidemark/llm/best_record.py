"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def code_key(column: Column | str) -> Column:
    """Spelling-free form of a source code: small letters and digits only, so ``Net Counter`` is ``net_counter``."""
    return F.regexp_replace(F.lower(F.col(column) if isinstance(column, str) else column), "[^a-z0-9]", "")


def candidate_values(rows: DataFrame, sources: DataFrame, *, group: str, value: tuple[str, ...], trust: str, recency: str, fill: str) -> DataFrame:
    """One row per (group, value) with ``n_rows``, the distinct canonical source codes of its rows, its latest recency
    and the latest non-null ``fill``. All of it is one aggregation with partial ones before its shuffle, so a hot group
    arrives as its few distinct values; code sets are bounded by the table of sources. Rows in which a part of the
    value is null share one row with null values."""
    canonical = sources.select(code_key("source_code").alias("code"), "source_code").where("code != ''").groupBy("code").agg(F.min("source_code").alias("source_code"))
    whole = F.forall(F.array(*[F.col(v).isNotNull() for v in value]), lambda x: x)
    spelled = rows.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), *[F.when(whole, F.col(v)).alias(f"v{i}") for i, v in enumerate(value)], F.col(recency).alias("at"), F.col(fill).alias("fill"),
        F.posexplode_outer(F.array_distinct(F.transform(trust, code_key))).alias("nth", "code"),
    )
    return spelled.join(canonical, "code", "left").groupBy("g", *[f"v{i}" for i in range(len(value))]).agg(
        F.count_if(F.coalesce("nth", F.lit(0)) == 0).alias("n_rows"), F.max("at").alias("at"),
        F.max(F.when(F.col("fill").isNotNull(), F.struct(F.col("at").isNotNull().alias("known"), "at", "fill"))).alias("fill"),
        F.sort_array(F.collect_set("source_code")).alias("codes"),
    )


def fingerprints(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes of a value."""
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0, 1)]


def listed_sets(exclusions: DataFrame, values: DataFrame, *, group: str, observed: str) -> DataFrame:
    """``g, n, x0, x1``: size and fingerprint of each listed set of values; xor makes it independent of order. A null
    list, or one with a value that isn't whole, describes no set."""
    parts = [c for c in values.columns if c[0] == "v" and c[1:].isdigit()]
    kinds, item = dict(values.dtypes), next(f.dataType.elementType for f in exclusions.schema.fields if f.name == observed)
    cast = F.transform(observed, lambda x: F.struct(*[x[f.name].cast(kinds[p]).alias(p) for f, p in zip(item.fields, parts, strict=True)]))
    listed = exclusions.where(F.col(group).isNotNull() & F.col(observed).isNotNull()).select(F.col(group).alias("g"), F.array_distinct(cast).alias("listed"))
    fold = lambda i: F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(fingerprints(*[x[p] for p in parts])[i]))
    folded = [fold(i).alias(f"x{i}") for i in range(2)]
    return listed.where(F.forall("listed", lambda x: F.forall(F.array(*[x[p].isNotNull() for p in parts]), lambda y: y))).select("g", F.size("listed").cast("long").alias("n_values"), *folded).distinct()


def best_representative(
    rows: DataFrame,
    sources: DataFrame,
    exclusions: DataFrame,
    *,
    group: str,
    value: tuple[str, ...],
    trust: str,
    recency: str,
    fill: str,
    observed: str,
    min_rows: int = 2,
) -> DataFrame:
    """``group, <value…>, <fill>, source_codes, n_rows, n_values`` for each group of at least ``min_rows`` rows.

    The surviving value is backed by the most distinct canonical sources over all its rows, then is the most recent
    (null is oldest), then the smallest; a value with a null part survives only where the group has no whole one, and
    is null then. ``fill`` is built apart from it: the latest non-null one of all rows, then the greatest. Groups whose
    values still equal a reviewed exclusion don't come out. Unknown, empty and null source codes back nothing; repeated
    rows count towards ``min_rows``. Rows with a null group stand for no group. Empty tables give no rows."""
    parts = [f"v{i}" for i in range(len(value))]
    values = candidate_values(rows, sources, group=group, value=value, trust=trust, recency=recency, fill=fill)
    mine, pair = W.partitionBy("g"), F.col(parts[0]).isNotNull()
    rank = mine.orderBy(F.col(parts[0]).isNull(), F.size("codes").desc(), F.col("at").desc_nulls_last(), *parts)
    ranked = values.select(
        "g", *parts, "codes", F.row_number().over(rank).alias("rn"), F.sum("n_rows").over(mine).alias("n_rows"), F.count(parts[0]).over(mine).alias("n_values"), F.max("fill").over(mine).alias("fill"),
        *[F.coalesce(F.bit_xor(F.when(pair, x)).over(mine), F.lit(0)).alias(f"x{i}") for i, x in enumerate(fingerprints(*map(F.col, parts)))],
    )
    return (
        ranked.where((F.col("rn") == 1) & (F.col("n_rows") >= min_rows)).join(listed_sets(exclusions, values, group=group, observed=observed), ["g", "n_values", "x0", "x1"], "left_anti")
        .select(F.col("g").alias(group), *[F.col(p).alias(v) for p, v in zip(parts, value, strict=True)], F.col("fill.fill").alias(fill), F.concat_ws(",", "codes").alias("source_codes"), "n_rows", "n_values")
    )
