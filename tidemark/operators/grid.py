"""Score grids with cells as rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.probability import log_loss, low_score_factor


def marginal(rate: Column, support: int) -> Column:
    """Poisson probabilities of 0 to ``support`` as an array; factorials are literals."""
    return F.array(*[F.exp(-rate + k * F.ln(rate) - math.lgamma(k + 1)) for k in range(support + 1)])


def score_rows(df: DataFrame, keep: Sequence[str], home: Column, away: Column, rho: Column, support: int = 12) -> DataFrame:
    """A row for each score up to ``support`` a side: ``<keep>, h, a, p``, normalised. The marginals are computed once
    a row, the normaliser from their sums and the four corrected cells, so a grid needs no shuffle."""
    base = df.select(*keep, home.alias("_rh"), away.alias("_ra"), rho.alias("_rho")).withColumn("_ph", marginal(F.col("_rh"), support)).withColumn("_pa", marginal(F.col("_ra"), support))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    factor = lambda h, a: low_score_factor(h, a, F.col("_rh"), F.col("_ra"), F.col("_rho"))
    z = total("_ph") * total("_pa")
    for h, a in ((0, 0), (0, 1), (1, 0), (1, 1)):
        z = z + F.col("_ph")[h] * F.col("_pa")[a] * (factor(F.lit(h), F.lit(a)) - 1)
    n = support + 1
    cells = base.withColumn("_z", z).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))).withColumn("h", F.floor(F.col("_c") / n).cast("int")).withColumn("a", (F.col("_c") % n).cast("int"))
    return cells.select(*keep, "h", "a", (F.col("_ph")[F.col("h")] * F.col("_pa")[F.col("a")] * factor(F.col("h"), F.col("a")) / F.col("_z")).alias("p"))


def outcome_probabilities(cells: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``<keep>, home_win, draw, away_win`` of score rows; summed before the shuffle."""
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0)).alias(name)
    return cells.groupBy(*keep).agg(part(F.col("h") > F.col("a"), "home_win"), part(F.col("h") == F.col("a"), "draw"), part(F.col("h") < F.col("a"), "away_win"))


def tilted(cells: DataFrame, keys: Sequence[str], features: dict[str, Column], weights: dict[str, float], within: Sequence[str] = ()) -> DataFrame:
    """Cells reweighted by ``exp(sum weight * feature)`` and normalised again; with ``within`` only inside those parts,
    whose probabilities then stay what they were. The largest exponent is taken out first. Sums are windows over one
    sort, never joins of the cells with them. Where only sums over the cells are wanted, see :func:`tilted_sums`."""
    eta = F.lit(0.0)
    for name, w in weights.items():
        eta = eta + w * features[name]
    part = W.partitionBy(*keys, *within)
    scored = cells.withColumn("_eta", eta).withColumn("_top", F.max("_eta").over(part)).withColumn("_part", F.sum("p").over(part))
    lifted = scored.withColumn("_q", F.col("p") * F.exp(F.col("_eta") - F.col("_top")))
    return lifted.withColumn("p", F.col("_q") / F.sum("_q").over(part) * (F.col("_part") if within else F.lit(1.0))).drop("_eta", "_top", "_part", "_q")


def tilted_sums(cells: DataFrame, keys: Sequence[str], features: dict[str, Column], weights: dict[str, float], sums: dict[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """``keys`` and, for each of ``sums``, its sum over the cells as :func:`tilted` reweights them, times their ``p``.
    Cells are summed by part before the shuffle, so a few rows a key are shuffled. Exponents must be below 700."""
    eta = F.lit(0.0)
    for name, w in weights.items():
        eta = eta + w * features[name]
    q = F.col("p") * F.exp(eta)
    parts = cells.groupBy(*keys, *within).agg(F.sum(q).alias("_s"), F.sum("p").alias("_part"), *[F.sum(x * q).alias(name) for name, x in sums.items()])
    return parts.groupBy(*keys).agg(*[F.sum(F.col(name) / F.col("_s") * (F.col("_part") if within else F.lit(1.0))).alias(name) for name in sums])


def tempered_cells(cells: DataFrame, keys: Sequence[str], temperature: float) -> DataFrame:
    """Cells with ``p`` to the power of one over the temperature, normalised again."""
    raised = cells.withColumn("_q", F.when(F.col("p") > 0, F.exp(F.ln("p") / temperature)).otherwise(0.0))
    return raised.withColumn("p", F.col("_q") / F.sum("_q").over(W.partitionBy(*keys))).drop("_q")


def convolved(df: DataFrame, first: Callable[[Column], Column], second: Callable[[Column], Column], support: int) -> DataFrame:
    """``df`` with a row for each sum ``k`` of two independent counts up to ``support``, and its probability ``p``."""
    counts = F.sequence(F.lit(0), F.lit(support))
    told = df.withColumn("_a", F.transform(counts, first)).withColumn("_b", F.transform(counts, second)).withColumn("k", F.explode(counts))
    total = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0.0), lambda s, i: s + F.col("_a")[i] * F.col("_b")[F.col("k") - i])
    return told.withColumn("p", total).drop("_a", "_b")


def metrics(cells: DataFrame, keys: Sequence[str], home: str, away: str, by: Sequence[str]) -> DataFrame:
    """Means of eleven metrics over grids, in millionths: log losses of the exact score, both sides' goals, their sum and
    difference and the outcome; Brier scores of the outcome, of both sides scoring and of more than two goals; the ranked
    score of the sum; and how often the likeliest score, of equal ones the smaller, was right. Cells are summed by their
    total before grids are."""
    h, a, y, x, p = (F.col(c) for c in ("h", "a", home, away, "p"))
    part = lambda c, name: F.sum(F.when(c, p).otherwise(0.0)).alias(name)
    rounded = F.floor(p * 1e6 + 0.5).cast("bigint")
    totals = cells.groupBy(*keys, home, away, (h + a).alias("_k")).agg(
        F.sum("p").alias("_t"), part((h == y) & (a == x), "_e"), part(h == y, "_hm"), part(a == x, "_am"), part(h - a == y - x, "_dm"), part(h > a, "_w"), part(h == a, "_d"), part(h < a, "_l"),
        part((h > 0) & (a > 0), "_b"), F.max(F.struct(rounded.alias("m"), (-h).alias("h"), (-a).alias("a"))).alias("_top"),
    )
    cdf = F.sum("_t").over(W.partitionBy(*keys).orderBy("_k"))
    k, s = F.col("_k"), y + x
    far = F.col("_f") - (s <= k).cast("int")
    each = totals.withColumn("_f", cdf).groupBy(*keys, home, away).agg(
        *[F.sum(c).alias(c) for c in ("_e", "_hm", "_am", "_dm", "_w", "_d", "_l", "_b")], F.sum(F.when(k == s, F.col("_t")).otherwise(0.0)).alias("_tm"), F.sum(F.when(k > 2, F.col("_t")).otherwise(0.0)).alias("_o"), F.sum(far * far).alias("_rps"), F.max("_top").alias("_top")
    )
    outcome = F.when(y > x, F.col("_w")).when(y == x, F.col("_d")).otherwise(F.col("_l"))
    off = lambda c, hit: (F.col(c) - hit.cast("int")) * (F.col(c) - hit.cast("int"))
    mean = lambda c, name: F.floor(F.avg(c) * 1e6 + 0.5).cast("bigint").alias(name)
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[mean(log_loss(F.col(c)), n) for c, n in (("_e", "exact"), ("_hm", "home"), ("_am", "away"), ("_tm", "total"), ("_dm", "difference"))], mean(log_loss(outcome), "outcome"),
        mean(off("_w", y > x) + off("_d", y == x) + off("_l", y < x), "outcome_brier"), mean(off("_b", (y > 0) & (x > 0)), "both_score_brier"), mean(off("_o", s > 2), "over_brier"), mean(F.col("_rps"), "total_rps"),
        mean(((F.col("_top.h") == -y) & (F.col("_top.a") == -x)).cast("int"), "top_hit"),
    )
