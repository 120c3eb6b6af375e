import random

import pytest

from tidemark.operators.asof_shards import known_before

E = "event_id long, team string, at long, id long"
V = "team string, at long, kind string, id long, event_id string"
ARGS = dict(event_id="event_id", event_entity="team", event_time="at", version_entity="team", version_time="at", version_id="id", version_kind="kind", kinds=("a", "b"))


def brute(events, versions, strict=True):
    out = set()
    for e, team, t, _ in events:
        for kind in ("a", "b"):
            found = [(-x[1], x[3]) for x in versions if team is not None and t is not None and x[0] == team and x[1] is not None and (x[1] < t or not strict and x[1] == t) and x[2] == kind and x[3] is not None]
            if found:
                at = min(found)[0]
                out.add((e, kind, min(i for a, i in found if a == at), -at))
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [3, 20, 10_000, None])
@pytest.mark.parametrize("strict", [True, False])
def test_against_brute_force(spark, shard_rows, strict):
    r = random.Random(shard_rows or 0)
    team = lambda: r.choice(["hot", "hot", "hot", "x", "y", None])
    when = lambda: r.choice([None, *range(60)])
    events = [(i, team(), when(), 9) for i in range(150)]
    versions = [(team(), when(), r.choice("abc"), r.choice([None, *range(50)]), "clash") for _ in range(150)]
    got = known_before(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), shard_rows=shard_rows, strict=strict, **ARGS)
    assert sorted(tuple(x) for x in got.collect()) == brute(events, versions, strict)


def test_later_versions_never_change_what_was_known(spark):
    events = [(1, "x", 10, 0)]
    versions = [("x", 5, "a", 1, ""), ("x", 10, "a", 2, ""), ("x", 11, "a", 3, "")]
    got = known_before(spark.createDataFrame(events, E), spark.createDataFrame(versions, V), **ARGS).collect()
    assert [tuple(r) for r in got] == [(1, "a", 1, 5)]


def test_empty(spark):
    none_e, none_v = spark.createDataFrame([], E), spark.createDataFrame([], V)
    assert known_before(none_e, none_v, **ARGS).count() == 0
    assert known_before(spark.createDataFrame([(1, "x", 10, 0)], E), none_v, **ARGS).count() == 0
