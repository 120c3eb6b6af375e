import random

import pytest

from tidemark.llm.best_record import best_representative

S = "fixture_id string, home_goals int, away_goals int, season_id string, codes array<string>, at long, g string"
SRC = "source_code string, source_name string"
EX = "fixture_id string, observed array<struct<home_goals:int,away_goals:int>>"
ARGS = dict(group="fixture_id", value=("home_goals", "away_goals"), trust="codes", recency="at", fill="season_id", observed="observed")
CODES = ["net_counter", "goal_ledger", "match_vault"]


def brute(rows, excluded):
    out = []
    canon = {c.replace("_", ""): c for c in CODES}
    for f in sorted({r[0] for r in rows if r[0] is not None}):
        mine = [r for r in rows if r[0] == f]
        if len(mine) < 2:
            continue
        pairs = {(r[1], r[2]) for r in mine if None not in r[1:3]}
        if any(x[0] == f and x[1] is not None and {tuple(y) for y in x[1]} == pairs for x in excluded):
            continue
        seasons = [(r[5] is not None, r[5] or 0, r[3]) for r in mine if r[3] is not None]
        season = max(seasons)[2] if seasons else None

        def backing(p, mine=mine):
            its = [r for r in mine if (r[1], r[2]) == p or (p == (None, None) and None in r[1:3])]
            codes = sorted({canon[k] for r in its for c in (r[4] or []) if c is not None and (k := "".join(x for x in c.lower() if x.isalnum())) in canon})
            times = [r[5] for r in its if r[5] is not None]
            return codes, (-len(codes), -(max(times) if times else -1), *(p if p[0] is not None else (0, 0)))

        best = min(pairs, key=lambda p: backing(p)[1]) if pairs else (None, None)
        out.append((f, *best, season, ",".join(backing(best)[0])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    spell = [None, "", "Net Counter", " net-counter ", "NetCounter", "GOAL_LEDGER", "goal_ledger", "match vault", "unknown"]
    goals = lambda: r.choice([None, 0, 1, 1, 2])
    rows = [(r.choice(["a", "b", "c", "d", "e", None, "one"]) if i else "single", goals(), goals(), r.choice([None, "s1", "s2"]), r.choice([None, [], r.choices(spell, k=3)]), r.choice([None, 1, 2, 3]), "clash") for i in range(60)]
    rows += rows[:5]
    excluded = [("a", [(r[1], r[2]) for r in rows if r[0] == "a" and None not in r[1:3]]), ("b", [(9, 9)]), ("c", None), ("d", []), (None, [(1, 1)])]
    got = best_representative(spark.createDataFrame(rows, S), spark.createDataFrame([(c, c) for c in CODES], SRC), spark.createDataFrame(excluded, EX), **ARGS)
    assert sorted(tuple(x)[:5] for x in got.collect()) == brute(rows, excluded)


def test_empty(spark):
    none = spark.createDataFrame([], S)
    assert best_representative(none, spark.createDataFrame([], SRC), spark.createDataFrame([], EX), **ARGS).count() == 0
