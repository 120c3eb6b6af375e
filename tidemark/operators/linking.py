"""Scoring candidate links and keeping those that are mutually best by a margin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.asof import band_join
from tidemark.session import cut


def link_score(evidence: Sequence[tuple[Column, int]], reject: Column) -> Column:
    """Sum of the weights whose condition holds; null where the pair is rejected."""
    total = F.lit(0)
    for condition, weight in evidence:
        total = total + F.when(condition, weight).otherwise(0)
    return F.when(~F.coalesce(reject, F.lit(False)), total)


def mutual_best(pairs: DataFrame, group: Sequence[str], left: str, right: str, score: str, threshold: int, margin: int) -> DataFrame:
    """Pairs that reach the threshold, are the best of both their ends and beat the next best of either by the margin;
    then again among the ends that are left, until a round links nothing. Each round is two windows and two anti-joins
    over what is left, written to the shared folder."""
    left_pairs = cut(pairs.where(F.col(score) >= threshold).select(*group, left, right, score).distinct())
    found: DataFrame | None = None
    while True:
        gap = lambda end: F.col(score) - F.coalesce(F.lead(score).over(W.partitionBy(*group, end).orderBy(F.desc(score), *([right] if end == left else [left]))), F.lit(-margin))
        place = lambda end: F.row_number().over(W.partitionBy(*group, end).orderBy(F.desc(score), *([right] if end == left else [left])))
        best = cut(left_pairs.withColumn("_l", place(left)).withColumn("_r", place(right)).withColumn("_gl", gap(left)).withColumn("_gr", gap(right)).where((F.col("_l") == 1) & (F.col("_r") == 1) & (F.col("_gl") >= margin) & (F.col("_gr") >= margin)).select(*group, left, right, score))
        if best.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        left_pairs = cut(left_pairs.join(best.select(*group, left), [*group, left], "left_anti").join(best.select(*group, right), [*group, right], "left_anti"))
    return found if found is not None else left_pairs.where("1 = 0")


def resolve(rows: DataFrame, source_key: Sequence[str], natural_key: Sequence[str], known: DataFrame, entities: DataFrame, new_id: Column) -> DataFrame:
    """Get or create: the id the source key is mapped to, else that of the one entity with the natural key, else the
    row's own stable id. ``known``: source key and ``entity_id``; ``entities``: natural key and ``entity_id``."""
    k = known.groupBy(*source_key).agg(F.min("entity_id").alias("_mapped"))
    n = entities.groupBy(*natural_key).agg(F.min("entity_id").alias("_natural"), F.count_distinct("entity_id").alias("_n")).where("_n = 1").drop("_n")
    method = F.when(F.col("_mapped").isNotNull(), "mapped").when(F.col("_natural").isNotNull(), "natural").otherwise("created")
    return rows.join(k, list(source_key), "left").join(n, list(natural_key), "left").withColumn("method", method).withColumn("entity_id", F.coalesce("_mapped", "_natural", new_id)).drop("_mapped", "_natural")


def nearest_by_name(left: DataFrame, right: DataFrame, left_id: str, right_id: str, time: str, name: str, tolerance: int, margin: int) -> DataFrame:
    """``left_id, right_id, distance, ambiguous``: the nearest right row in time within the tolerance among those whose
    normalised name holds the left one's words in a row, or lies in it; ambiguous where the next is less than ``margin``
    farther. Names that hold each other share words, so pairs meet by a word and a bin of time."""
    words = lambda df, i: df.where(F.col(name) != "").select(i, time, name, F.explode(F.array_distinct(F.split(name, " "))).alias("word"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    pairs = band_join(words(left, left_id), words(right, right_id), ["word"], time, time, tolerance, tolerance)
    held = pairs.where(F.contains(spaced(name), spaced(f"r_{name}")) | F.contains(spaced(f"r_{name}"), spaced(name))).select(left_id, F.col(f"r_{right_id}").alias(right_id), F.abs(F.col(f"r_{time}") - F.col(time)).alias("distance")).distinct()
    w = W.partitionBy(left_id).orderBy("distance", right_id)
    ranked = held.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w)).where("_rn = 1")
    return ranked.select(left_id, right_id, "distance", F.coalesce(F.col("_next") - F.col("distance") < margin, F.lit(False)).alias("ambiguous"))


def tiered(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """``left_id, right_id, tier``: candidates that agree in all columns of a tier; of several tiers the first."""
    out = None
    for i, keys in enumerate(tiers, 1):
        part = left.join(right.select(right_id, *keys), list(keys)).select(left_id, right_id, F.lit(i).alias("tier"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy(left_id, right_id).agg(F.min("tier").alias("tier"))


def relink(entities: DataFrame, placeholder: Column, entity_id: str, natural: Sequence[str]) -> DataFrame:
    """``entity_id, linked_id`` of placeholders: the one real entity with the natural key of any of its rows, else
    itself; of several rows with one each the greatest id."""
    real = entities.where(~placeholder).groupBy(*natural).agg(F.min(entity_id).alias("_id"), F.count_distinct(entity_id).alias("_n")).where("_n = 1")
    found = entities.where(placeholder).join(real, list(natural), "left").groupBy(entity_id).agg(F.max("_id").alias("_id"))
    return found.select(entity_id, F.coalesce("_id", entity_id).alias("linked_id"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the least node that each is linked to by any path. Every round gives a node the least label
    among its own, its neighbours' and its label's, so chains shorten by half; it ends when no label falls. Labels and
    edges stay on the cluster, each round's are written to the shared folder."""
    both = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e")).select("e.x", "e.y").distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        after = cut(labels.join(near, "node").join(jump, "component").select("node", F.least("component", "near", "jump").alias("component"), (F.least("near", "jump") < F.col("component")).alias("fell")))
        labels = after.select("node", "component")
        if not after.where("fell").head(1):
            return labels
