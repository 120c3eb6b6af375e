"""Summaries, calibration and resampling. Every one is one or two aggregations with partial sums before the shuffle."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64) -> DataFrame:
    """``n, mean, median, p90, p95, max`` with exact, linearly interpolated quantiles.

    No task holds all values of a key: its values are counted by distinct value and dealt to ``buckets`` at about equal
    shares of rows; sums over the buckets tell in which of them each wanted rank lies, and only those are ordered."""
    wanted = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    per = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("_cuts"))
    named = lambda df, tag, of=keys: df.select(*[F.col(x).alias(f"_{tag}{i}") for i, x in enumerate(of)], *[c for c in df.columns if c not in of])
    same = lambda a, b: [F.col(f"_{a}{i}").eqNullSafe(F.col(f"_{b}{i}")) for i in range(len(keys))]
    names = [f"_k{i}" for i in range(len(keys))]
    cells = named(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")).withColumnRenamed(value, "v"), "k")
    cuts = named(per.select(*keys, "n", "_cuts"), "q")
    dealt = cells.join(cuts, same("k", "q")).select(*names, "v", "c", "n", F.size(F.filter("_cuts", lambda x: x < F.col("v"))).alias("b"))
    before = F.sum("c").over(W.partitionBy(*names).orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    ranks = F.array(*[f(F.lit(q) * (F.col("n") - 1)) for q in wanted.values() for f in (F.floor, F.ceil)])
    whole = dealt.groupBy(*names, "n", "b").agg(F.sum("c").alias("c")).withColumn("start", F.coalesce(before, F.lit(0)))
    hit = whole.where(F.exists(ranks, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("c")))).select(*names, F.col("b").alias("_b"), "start")
    there = dealt.join(named(hit, "h", names), [*same("k", "h"), F.col("b") == F.col("_b")]).select(*names, "v", "c", "n", "b", "start")
    end = F.col("start") + F.sum("c").over(W.partitionBy(*names, "b").orderBy("v"))
    placed = there.withColumn("_end", end).withColumn("_from", F.col("_end") - F.col("c"))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_end")), F.col("v")))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    found = placed.groupBy(*names, "n").agg(*[x for name, q in wanted.items() for x in (at(F.floor(place(q))).alias(f"{name}_lo"), at(F.ceil(place(q))).alias(f"{name}_hi"))])
    exact = found.select(*names, *[(F.col(f"{x}_lo") + (F.col(f"{x}_hi") - F.col(f"{x}_lo")) * (place(q) - F.floor(place(q)))).alias(x) for x, q in wanted.items()])
    left = named(per.drop("_cuts"), "e")
    return left.join(exact, same("e", "k"), "left").select(*[F.col(f"_e{i}").alias(x) for i, x in enumerate(keys)], "n", "mean", *wanted, "max")


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """``weighted_mean`` and the effective sample size ``(sum w)^2 / sum w^2``."""
    w, x = F.col(weight), F.col(value)
    return df.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("weighted_mean"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))


def inverse_coverage_weights(df: DataFrame, stratum: Sequence[str], covered: str, floor: float, cap: float) -> DataFrame:
    """Covered rows with the weight 1 / coverage of their stratum, at most ``cap``; strata covered less than ``floor``
    have none, a null weight."""
    rate = df.groupBy(*stratum).agg(F.avg(F.col(covered).cast("double")).alias("coverage"))
    return df.where(covered).join(rate, list(stratum)).withColumn("weight", F.when(F.col("coverage") >= floor, F.least(1 / F.col("coverage"), F.lit(cap))))


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The commonest non-null value of each key, of equally common ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def upper_bound_bin(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound at or above the value; beyond all, their number."""
    out = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        out = F.when(value <= b, i).otherwise(out)
    return F.when(value.isNotNull(), out)


def expected_calibration_error(df: DataFrame, keys: Sequence[str], probability: str, hit: str, bins: int = 10) -> DataFrame:
    """Mean distance of bin means and hit rates over equal bins, weighted by their rows; 1 belongs to the last bin."""
    binned = df.withColumn("_bin", F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)))
    per = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(F.col(hit).cast("double")).alias("y"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def calibration_table(df: DataFrame, probability: str, hit: str, edges: Sequence[float]) -> DataFrame:
    """``bin, n, mean_probability, hit_rate`` over half-open bins, the last one closed; values outside are left out."""
    p = F.col(probability)
    bin_ = F.coalesce(*[F.when((p >= a) & ((p < b) if b != edges[-1] else (p <= b)), i) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    return df.withColumn("bin", bin_).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def exceedance(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of non-null values above each threshold: one aggregate, turned into rows."""
    agg = df.agg(*[F.avg((F.col(value) > t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def evenly_spaced(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Of n rows in order, those at the rounded places ``i (n - 1) / (k - 1)``, halves to even; all if n <= k. The place
    of a row comes from range partitions and their counts, not from sorting everything in one task."""
    n = df.count()
    if n <= k:
        return df
    places = [round(i * (n - 1) / (k - 1)) for i in range(k)] if k > 1 else [0]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = sorted_rows.groupBy("_p").agg(F.count(F.lit(1)).alias("c"), F.min("_m").alias("first"))
    starts = sizes.withColumn("_start", F.sum("c").over(W.orderBy("_p")) - F.col("c"))  # one row a partition
    return sorted_rows.join(F.broadcast(starts), "_p").withColumn("_place", F.col("_start") + F.col("_m") - F.col("first")).where(F.col("_place").isin(places)).drop("_p", "_m", "c", "first", "_start", "_place")


def block_bootstrap(df: DataFrame, block: str, value: str, replicates: int, seed: int) -> DataFrame:
    """``mean, low, high, share_below_zero`` of a mean under resampling of whole blocks. Blocks are reduced to their
    count and sum; the draws are made from a seeded generator once and joined, so results repeat to the bit."""
    sums = df.groupBy(block).agg(F.count(value).alias("n"), F.sum(value).alias("s")).orderBy(block)
    blocks = [tuple(r) for r in sums.collect()]  # one row a block, months or the like
    if not blocks:
        return df.sparkSession.createDataFrame([], "mean double, low double, high double, share_below_zero double")
    generator = random.Random(seed)
    rows = [(i, generator.randrange(len(blocks))) for i in range(replicates) for _ in blocks]
    at = df.sparkSession.createDataFrame(rows, "replicate int, at int")
    index = df.sparkSession.createDataFrame([(i, n, float(s or 0)) for i, (_, n, s) in enumerate(blocks)], "at int, n long, s double")
    means = at.join(F.broadcast(index), "at").groupBy("replicate").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.lit(sum(float(s or 0) for _, _, s in blocks) / sum(n for _, n, _ in blocks)).alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("m") < 0).cast("double")).alias("share_below_zero"))


def shrunk(df: DataFrame, keys: Sequence[str], position: str, value: str, weight: float) -> DataFrame:
    """``keys, position, n, shrunk``: means by key and position, drawn to the position's mean as by ``weight`` rows more.
    Positions' means come from the sums of their keys, so the rows are read once."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, position).agg(F.sum(value).alias("_s"), F.count(value).alias("n"))
    whole = per.groupBy(position).agg((F.sum("_s") / F.sum("n")).alias("_m"))
    return per.join(whole, position).select(*keys, position, "n", ((weight * F.col("_m") + F.col("_s")) / (weight + F.col("n"))).alias("shrunk"))


def dirichlet_bins(df: DataFrame, key: str, bin_column: str, bins: int, prior: float) -> DataFrame:
    """``key, bin, n, p`` for bins 0 to ``bins - 1`` of each key: shares with ``prior`` added to each bin's count."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(bin_column) == i).alias(f"b{i}") for i in range(bins)])
    total = sum((F.col(f"b{i}") for i in range(1, bins)), F.col("b0"))
    each = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("n"), ((prior + F.col(f"b{i}")) / (bins * prior + total)).alias("p")) for i in range(bins)])
    return counts.select(key, F.explode(each).alias("x")).select(key, "x.*")
