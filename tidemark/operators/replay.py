"""Event-time state: decayed evidence in closed form, and coupled states as an ordered fold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.linking import components


def decayed_evidence(df: DataFrame, entity: Sequence[str], time: str, value: str, half_life: float, prior: float, strength: float, epoch: float) -> DataFrame:
    """Adds ``evidence_weight`` and ``evidence_mean``: exponentially decayed count and mean of the entity's values at
    strictly earlier times, shrunk to ``prior`` with ``strength``.

    ``sum x 2^-((t - ti) / h)`` is ``2^-(t / h)`` times a running sum of ``x 2^(ti / h)``, so one range window does it,
    without pairs. Exponents count from the start of an epoch of ``epoch`` time units. Sums of earlier epochs are carried in,
    decayed, from one row per (entity, epoch). Null values add nothing but their rows still get evidence."""
    t, era = F.col(time).cast("double"), F.floor(F.col(time) / epoch)
    lift = F.exp(F.lit(math.log(2) / half_life) * (t - era * epoch))
    rows = df.withColumn("_era", era).withColumn("_lift", lift).withColumn("_w", F.when(F.col(value).isNotNull(), F.col("_lift"))).withColumn("_x", F.col(value) * F.col("_lift"))
    per = rows.groupBy(*entity, "_era").agg(F.sum("_w").alias("w"), F.sum("_x").alias("x"))
    # sums brought to the start of the following eras; the exponent is the distance of eras, so nothing overflows
    each = W.partitionBy(*entity).orderBy("_era").rowsBetween(W.unboundedPreceding, -1)
    past = F.collect_list(F.struct("_era", "w", "x")).over(each)
    fade = lambda p: F.exp(F.lit(-math.log(2) / half_life) * (F.col("_era") - p["_era"]) * epoch)
    total = lambda f: F.aggregate(past, F.lit(0.0), lambda s, p: s + F.coalesce(p[f], F.lit(0.0)) * fade(p))
    carried = per.select(*entity, "_era", total("w").alias("_cw"), total("x").alias("_cx"))
    before = W.partitionBy(*entity, "_era").orderBy(time).rangeBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_sw", F.coalesce(F.sum("_w").over(before), F.lit(0.0))).withColumn("_sx", F.coalesce(F.sum("_x").over(before), F.lit(0.0)))
    joined = inside.join(carried, [*entity, "_era"])
    weight, sum_ = (F.col("_cw") + F.col("_sw")) / F.col("_lift"), (F.col("_cx") + F.col("_sx")) / F.col("_lift")
    return joined.select(*df.columns, weight.alias("evidence_weight"), ((strength * prior + sum_) / (strength + weight)).alias("evidence_mean"))


@dataclass(frozen=True)
class ReplaySpec:
    """Priors and half-lives, in days; ``defence_sign`` is -1 where a good defence lowers the opponent's rate."""

    level: float = math.log(1.25)
    level_sd: float = 0.3
    level_half_life: float = 730.0
    home: float = 0.1397619424
    home_sd: float = 0.25
    team_sd: float = 0.45
    team_half_life: float = 180.0
    low: float = 0.05
    high: float = 6.0
    defence_sign: int = -1
    lead_minutes: int = 1440
    delay_minutes: int = 150


SNAPSHOT = T.StructType([T.StructField("fixture_id", T.LongType()), T.StructField("expected_home", T.DoubleType()), T.StructField("expected_away", T.DoubleType()), T.StructField("home_matches", T.LongType()), T.StructField("away_matches", T.LongType())])
MATCH = ("fixture_id", "home", "away", "competition", "home_goals", "away_goals", "neutral")


class Replay:
    """All states of one coupled group, as columns: what each is drawn back to, how far it is from there, how sure it is
    and since when. States are numbered as they first occur; matches are tuples of :data:`MATCH`."""

    def __init__(self, spec: ReplaySpec) -> None:
        self.spec = spec
        team = (0.0, spec.team_sd**2, spec.team_half_life)
        self.kinds = {"level": (spec.level, spec.level_sd**2, spec.level_half_life), "home": (spec.home, spec.home_sd**2, spec.level_half_life), "attack": team, "defence": team}
        self.number: dict[tuple, int] = {}
        self.centre, self.spread, self.pull, self.off, self.sure, self.since = ([] for _ in range(6))
        self.played: dict[int, int] = {}

    def _touched(self, match: tuple) -> list[tuple[int, float, float]]:
        """Numbers of the states that a match depends on, with their weights in the logs of both rates."""
        _, home, away, place, _, _, neutral = match
        d = self.spec.defence_sign
        out = []
        for kind, key, x, y in (("level", place, 1, 1), ("home", place, 0 if neutral else 1, 0), ("attack", home, 1, 0), ("defence", away, d, 0), ("attack", away, 0, 1), ("defence", home, 0, d)):
            if (n := self.number.get((kind, key))) is None:
                n = self.number[kind, key] = len(self.number)
                centre, spread, life = self.kinds[kind]
                for column, value in ((self.centre, centre), (self.spread, spread), (self.pull, math.log(2) / life), (self.off, 0.0), (self.sure, 1 / spread), (self.since, None)):
                    column.append(value)
            out.append((n, x, y))
        return out

    def rates(self, matches: list[tuple], now: float) -> list[tuple[list[tuple[int, float, float]], float, float]]:
        """The touched states of each match, brought to ``now``, and its two rates."""
        touched = [self._touched(m) for m in matches]
        for n in {n for t in touched for n, _, _ in t}:
            gone = 0.0 if self.since[n] is None else now - self.since[n]
            if gone > 0:
                kept = math.exp(-self.pull[n] * gone)
                self.off[n] *= kept
                self.sure[n] = 1 / (self.spread[n] + kept * kept * (1 / self.sure[n] - self.spread[n]))
            if gone > 0 or self.since[n] is None:
                self.since[n] = now
        low, high = math.log(self.spec.low), math.log(self.spec.high)
        rate = lambda t, side: math.exp(min(max(sum(x[side] * (self.centre[x[0]] + self.off[x[0]]) for x in t), low), high))
        return [(t, rate(t, 1), rate(t, 2)) for t in touched]

    def snapshots(self, matches: list[tuple], now: float) -> list[tuple]:
        return [(m[0], a, b, self.played.get(m[1], 0), self.played.get(m[2], 0)) for m, (_, a, b) in zip(matches, self.rates(matches, now), strict=True)]

    def results(self, matches: list[tuple], now: float) -> None:
        """All results of a time at once, at the states before it: what they teach is summed by state, then added."""
        slope, told = Counter(), Counter()
        for m, (touched, a, b) in zip(matches, self.rates(matches, now), strict=True):
            for n, x, y in touched:
                slope[n] += x * (m[4] - a) + y * (m[5] - b)
                told[n] += x * x * a + y * y * b
            self.played[m[1]] = self.played.get(m[1], 0) + 1
            self.played[m[2]] = self.played.get(m[2], 0) + 1
        for n, weight in told.items():
            self.sure[n] += weight
            self.off[n] += slope[n] / self.sure[n]


def fold(frames: Iterable[pd.DataFrame], spec: ReplaySpec, known: Replay | None = None) -> Iterator[pd.DataFrame]:
    """Batches of events sorted by group, time and phase, to snapshots. Only the states of one group and the matches of
    one time are kept, however many a group has. Of one group, what is ``known`` of it may be gone on from."""
    run, replay, held = None, known or Replay(spec), []
    out: list[tuple] = []

    def close() -> None:
        if held:
            if run[2]:
                replay.results(held, run[1] / 1440)
            else:
                out.extend(replay.snapshots(held, run[1] / 1440))
            held.clear()

    for frame in frames:
        for this, match in zip(zip(*(frame[c].tolist() for c in ("_g", "_t", "_phase")), strict=True), zip(*(frame[c].tolist() for c in MATCH), strict=True), strict=True):
            if this != run:
                close()
                if run is not None and this[0] != run[0]:
                    replay = Replay(spec)
                run = this
            held.append(match)
        yield pd.DataFrame(out, columns=SNAPSHOT.names)
        out.clear()
    close()
    yield pd.DataFrame(out, columns=SNAPSHOT.names)


def state_replay(matches: DataFrame, group: Column, spec: ReplaySpec) -> DataFrame:
    """Expected goals of every match as known ``lead_minutes`` before it. At every time all snapshots are taken before any
    result counts. The order of results is sequential by nature, so matches are grouped by what couples their states,
    see :func:`coupled`; a group's events run through one task as a sorted stream and are never collected."""
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return replay_events(matches, group, spec).repartition(parts, "_g").sortWithinPartitions("_g", "_t", "_phase", "fixture_id").mapInPandas(lambda frames: fold(frames, spec), SNAPSHOT)


def replay_events(matches: DataFrame, group: Column, spec: ReplaySpec) -> DataFrame:
    """Two events of each match with their ``_g``, ``_t`` and ``_phase``: its snapshot and its result."""
    event = lambda t, p: F.struct(t.alias("t"), F.lit(p).alias("p"))
    both = F.explode(F.array(event(F.col("kick") - spec.lead_minutes, 0), event(F.col("kick") + spec.delay_minutes, 1)))
    return matches.select(group.alias("_g"), *MATCH, both.alias("e")).select("_g", *MATCH, F.col("e.t").alias("_t"), F.col("e.p").alias("_phase"))


def coupled(matches: DataFrame) -> DataFrame:
    """``matches`` with ``group``, the same for all that are linked by a team or a competition."""
    team = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    place = F.concat(F.lit("c"), F.col("competition").cast("string"))
    edges = matches.select(team("home").alias("a"), team("away").alias("b")).unionAll(matches.select(team("home").alias("a"), place.alias("b"))).distinct()
    found = components(edges, "a", "b").select(F.col("node").alias("_n"), F.col("component").alias("group"))
    return matches.withColumn("_n", team("home")).join(found, "_n").drop("_n")


def running_scale(df: DataFrame, keys: Sequence[str], time: str, observed: str, expected: str, prior_observed: float, prior_expected: float) -> Column:
    """Observed over expected of all strictly earlier rows of the keys, with prior counts; a window column."""
    w = W.partitionBy(*keys).orderBy(time).rangeBetween(W.unboundedPreceding, -1)
    return (prior_observed + F.coalesce(F.sum(observed).over(w), F.lit(0.0))) / (prior_expected + F.coalesce(F.sum(expected).over(w), F.lit(0.0)))
