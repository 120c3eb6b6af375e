"""Distributions, scoring rules and calibration maps as column expressions, computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-15


def log_factorial(k: Column) -> Column:
    """ln k! as a sum of logarithms."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.exp(-rate + k * F.ln(rate) - log_factorial(k))


def negative_binomial(k: Column, mean: Column, shape: Column) -> Column:
    """Probability of a count with the given mean and variance ``mean + mean**2 / shape``; its binomial coefficient is a
    product of ``k`` factors. Null without a positive mean and shape."""
    r, m = shape.cast("double"), mean.cast("double")
    rising = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln((r + i - 1) / i))
    log = F.when(k > 0, rising).otherwise(0.0) + r * F.ln(r / (r + m)) + k * F.ln(m / (r + m))
    return F.when((r > 0) & (m > 0), F.exp(log))


def poisson_support(mean: Column, left_out: float, most: int) -> Column:
    """The least count up to which a distribution has all but ``left_out`` of its mass; null where that is beyond
    ``most``."""
    step = lambda acc, k: F.when(acc["f"] >= 1 - left_out, acc).otherwise(F.struct((acc["f"] + acc["p"] * mean / k).alias("f"), (acc["p"] * mean / k).alias("p"), k.cast("int").alias("k")))
    start = F.struct(F.exp(-mean).alias("f"), F.exp(-mean).alias("p"), F.lit(0).alias("k"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return F.when(end["f"] >= 1 - left_out, end["k"])


def low_score_gradient(h: Column, a: Column, home: Column, away: Column) -> Column:
    """Derivative of the log of :func:`low_score_factor` where there is no dependence; its square is the curvature."""
    return F.when((h == 0) & (a == 0), -home * away).when((h == 0) & (a == 1), home).when((h == 1) & (a == 0), away).when((h == 1) & (a == 1), F.lit(-1.0)).otherwise(F.lit(0.0))


def bivariate_poisson_pmf(h: Column, a: Column, home: Column, away: Column, shared: Column) -> Column:
    """Joint counts of two rates with a shared part."""
    term = lambda i: F.exp((h - i) * F.ln(home) - log_factorial(h - i) + (a - i) * F.ln(away) - log_factorial(a - i) + i * F.ln(shared) - log_factorial(i))
    return F.exp(-(home + away + shared)) * F.aggregate(F.sequence(F.lit(0), F.least(h, a).cast("int")), F.lit(0.0), lambda s, i: s + term(i))


def low_score_factor(h: Column, a: Column, home: Column, away: Column, rho: Column) -> Column:
    """The dependence correction of the four lowest scores."""
    return F.when((h == 0) & (a == 0), 1 - home * away * rho).when((h == 0) & (a == 1), 1 + home * rho).when((h == 1) & (a == 0), 1 + away * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(F.lit(1.0))


def log_loss(p: Column, floor: float = FLOOR) -> Column:
    return -F.ln(F.greatest(p, F.lit(floor)))


def brier(probabilities: dict[str, Column], outcome: Column) -> Column:
    """Sum of squared distances to the outcome over all classes."""
    return sum((p - (outcome == k).cast("double")) * (p - (outcome == k).cast("double")) for k, p in probabilities.items())


def ranked_probability_score(cumulative: list[Column], outcome_rank: Column) -> Column:
    """Squared distances of the cumulative probabilities to those of the outcome, averaged over the cuts."""
    return sum((c - (outcome_rank <= i).cast("double")) * (c - (outcome_rank <= i).cast("double")) for i, c in enumerate(cumulative)) / len(cumulative)


def tempered(probabilities: list[Column], temperature: Column) -> list[Column]:
    """Temperature scaling: the softmax of log p / T, shifted by its largest term."""
    scaled = [F.ln(F.greatest(p, F.lit(FLOOR))) / temperature for p in probabilities]
    top = F.greatest(*scaled)
    weights = [F.exp(x - top) for x in scaled]
    return [w / sum(weights[1:], weights[0]) for w in weights]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
