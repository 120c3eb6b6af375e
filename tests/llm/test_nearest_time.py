import random

import pytest

from tidemark.llm.nearest_time import nearest_in_time

ARGS = dict(left_id="p", left_entity="f", left_time="t", right_id="q", right_entity="f", right_time="t")
L, R = "p long, f string, t long, q long", "q long, f string, t long, p string"
SEC = 1_000_000


def brute(left, right, tolerance):
    out = []
    for p, f, t, _ in left:
        found = [(abs(x[2] - t), x[0]) for x in right if f is not None and t is not None and x[1] == f and x[2] is not None and x[0] is not None and abs(x[2] - t) <= tolerance * SEC]
        if found:
            out.append((p, min(found)[1], min(found)[0]))
    return sorted(out)


@pytest.mark.parametrize(("span", "step"), [(60, SEC), (7200, SEC), (45, 7 * SEC // 2), (61, 1)])
def test_against_brute_force(spark, span, step):
    r = random.Random(span)
    entity = lambda: r.choice(["hot", "hot", "hot", "x", None])
    when = lambda: r.choice([None] + [r.randrange(-500, 500) * step for _ in range(9)])
    left = [(i, entity(), when(), 0) for i in range(250)]
    right = [(r.choice([None, i]), entity(), when(), "clash") for i in range(250)] + [(1000 + i, "hot", 40 * step, "") for i in range(5)]
    got = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), tolerance_seconds=30, span_seconds=span, **ARGS)
    assert sorted(tuple(x) for x in got.collect()) == brute(left, right, 30)


def test_ties_tolerance_and_repeats(spark):
    left = [(1, "a", 0, 0), (1, "a", 0, 0), (2, "a", 1800 * SEC + 10 * SEC, 0), (3, "a", 1810 * SEC + 1, 0)]
    right = [(7, "a", -10 * SEC, ""), (5, "a", 10 * SEC, "")]
    got = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), **ARGS)
    assert sorted((x.left_id, x.right_id) for x in got.collect()) == [(1, 5), (1, 5), (2, 5)]


def test_empty(spark):
    assert nearest_in_time(spark.createDataFrame([], L), spark.createDataFrame([(1, "a", 0, "")], R), **ARGS).count() == 0
    assert nearest_in_time(spark.createDataFrame([(1, "a", 0, 0)], L), spark.createDataFrame([], R), **ARGS).count() == 0
