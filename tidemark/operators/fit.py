"""Small fits whose sums run on the cluster and whose steps run on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.probability import FLOOR, log_loss, negative_binomial, tempered


class NotConverged(ArithmeticError):
    """A fit ended at its most steps without settling."""


def temperature_losses(df: DataFrame, keys: Sequence[str], probabilities: Sequence[str], outcome: str, temperatures: Sequence[float]) -> DataFrame:
    """``keys, temperature, loss``: the mean log loss of each key at each temperature, in one aggregation."""
    each = df.select(*keys, outcome, *probabilities, F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    scaled = tempered([F.col(p) for p in probabilities], F.col("temperature"))
    loss = log_loss(F.coalesce(*[F.when(F.col(outcome) == i, p) for i, p in enumerate(scaled)]))
    return each.groupBy(*keys, "temperature").agg(F.avg(loss).alias("loss"))


def shape_profile(df: DataFrame, count: str, shapes: Sequence[float]) -> DataFrame:
    """``shape, log_likelihood`` of negative binomial counts at their own mean, from one row for each distinct count."""
    counts = df.where(F.col(count).isNotNull()).groupBy(F.col(count).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    mean = counts.agg((F.sum(F.col("_k") * F.col("_n")) / F.sum("_n")).alias("_m"))  # one row
    each = counts.crossJoin(F.broadcast(mean)).withColumn("shape", F.explode(F.array(*map(F.lit, shapes))))
    return each.groupBy("shape").agg(F.sum(F.col("_n") * F.ln(negative_binomial(F.col("_k"), F.col("_m"), F.col("shape")))).alias("log_likelihood"))


def fit_biases(df: DataFrame, probabilities: Sequence[str], outcome: str, steps: int = 30, tolerance: float = 1e-10) -> tuple[list[float], list[float]]:
    """Biases of the classes' log odds, the first zero, of least log loss, and the mean probabilities they give, which
    are the observed shares. A Newton step is one aggregation. A class that never occurs gets a bias at which
    next to nothing is left of it."""
    n, bias = len(probabilities), np.zeros(len(probabilities))
    for _ in range(steps):
        raised = [F.greatest(F.col(p), F.lit(FLOOR)) * math.exp(b) for p, b in zip(probabilities, bias.tolist(), strict=True)]
        total = sum(raised[1:], raised[0])
        q = [r / total for r in raised]
        cells = [F.avg(x).alias(f"q{i}") for i, x in enumerate(q)] + [F.avg((F.col(outcome) == i).cast("double")).alias(f"y{i}") for i in range(n)] + [F.avg(q[i] * q[j]).alias(f"c{i}_{j}") for i in range(1, n) for j in range(i, n)]
        row = df.agg(*cells).first()
        if row["q0"] is None:
            return bias.tolist(), []
        means = np.array([row[f"q{i}"] for i in range(n)])
        gradient = np.array([row[f"y{i}"] for i in range(n)]) - means
        if np.abs(gradient).max() < tolerance:
            return bias.tolist(), means.tolist()
        hessian = np.diag(means[1:]) - np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(1, n)] for i in range(1, n)])
        bias[1:] += np.clip(np.linalg.solve(hessian, gradient[1:]), -2, 2)
    raise NotConverged("biases")


def fit_tilt(cells: DataFrame, keys: Sequence[str], features: dict[str, Column], observed: dict[str, Column], steps: int = 30, tolerance: float = 1e-9) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of an exponential tilt of cells, ``p * exp(sum weight * feature)``, of the greatest likelihood of the
    observed cells, and the mean features they give, which are those observed. ``observed`` are the features of the
    observed cell, the same in all cells of a key. A Newton step sums moments within each key, then over the keys; the
    small system is solved on the driver."""
    names, k = list(features), len(features)
    weights = np.zeros(k)
    held = cells.select(*keys, "p", *[features[n].alias(f"_f{i}") for i, n in enumerate(names)], *[observed[n].alias(f"_o{i}") for i, n in enumerate(names)])
    f = [F.col(f"_f{i}") for i in range(k)]
    for _ in range(steps):
        eta = F.lit(0.0)
        for w, x in zip(weights.tolist(), f, strict=True):
            eta = eta + w * x
        q = F.col("p") * F.exp(eta)
        sums = held.groupBy(*keys).agg(F.sum(q).alias("z"), *[F.sum(q * x).alias(f"m{i}") for i, x in enumerate(f)], *[F.sum(q * f[i] * f[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], *[F.max(f"_o{i}").alias(f"o{i}") for i in range(k)])
        mean = [F.col(f"m{i}") / F.col("z") for i in range(k)]
        row = sums.agg(*[F.avg(m).alias(f"m{i}") for i, m in enumerate(mean)], *[F.avg(f"o{i}").alias(f"o{i}") for i in range(k)], *[F.avg(F.col(f"s{i}_{j}") / F.col("z") - mean[i] * mean[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if row["m0"] is None:
            return dict.fromkeys(names, 0.0), {}
        means = {n: row[f"m{i}"] for i, n in enumerate(names)}
        gradient = np.array([row[f"o{i}"] - row[f"m{i}"] for i in range(k)])
        if np.abs(gradient).max() < tolerance:
            return dict(zip(names, weights.tolist(), strict=True)), means
        covariance = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        weights += np.clip(np.linalg.solve(covariance + 1e-12 * np.eye(k), gradient), -0.5, 0.5)
    raise NotConverged("tilt")


def fit_temperature(df: DataFrame, probabilities: Sequence[str], outcome: str, low: float = 0.5, high: float = 2.0, points: int = 17, rounds: int = 4) -> float:
    """The temperature of least mean log loss. Every round evaluates a grid in one aggregation over all rows and
    narrows it to the neighbours of the best, so nothing is collected but one row a round."""
    for _ in range(rounds):
        grid = np.linspace(low, high, points).tolist()
        each = df.select(outcome, *probabilities, F.posexplode(F.array(*map(F.lit, grid))).alias("i", "t"))
        scaled = tempered([F.col(p) for p in probabilities], F.col("t"))
        loss = log_loss(F.coalesce(*[F.when(F.col(outcome) == i, p) for i, p in enumerate(scaled)]))
        row = {r["i"]: r["l"] for r in each.groupBy("i").agg(F.avg(loss).alias("l")).collect()}  # one row a grid point
        best = min(range(points), key=lambda i: row.get(i) if row.get(i) is not None else math.inf)
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return (low + high) / 2


def fit_poisson(df: DataFrame, target: str, offset: Column, features: Sequence[Column], ridge: float = 10.0, steps: int = 40, tolerance: float = 1e-8) -> list[float]:
    """Ridge-penalised Poisson regression with an offset by damped Newton steps. A step is one aggregation of the
    gradient and the upper half of the Hessian; the small system is solved on the driver."""
    k = len(features)
    beta = np.zeros(k)
    for _ in range(steps):
        eta = offset
        for b, x in zip(beta.tolist(), features, strict=True):
            eta = eta + b * x
        rate = F.exp(F.least(F.greatest(eta, F.lit(-20.0)), F.lit(20.0)))
        cells = [F.sum(x * (F.col(target) - rate)).alias(f"g{i}") for i, x in enumerate(features)] + [F.sum(features[i] * features[j] * rate).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = df.agg(*cells).first()
        gradient = np.array([row[f"g{i}"] or 0.0 for i in range(k)]) - ridge * beta
        hessian = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        beta += step
        if np.abs(step).max() < tolerance:
            return beta.tolist()
    raise NotConverged("Poisson regression")
