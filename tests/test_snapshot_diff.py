import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.snapshot_diff import snapshot_changes

S = "n int, key string, loaded long, status string, kick long, snapshot string"


def changes(df, **options):
    return snapshot_changes(df, snapshot="n", key="key", loaded="loaded", fields={"status": F.lower(F.trim("status")), "kick": F.col("kick")}, **options)


def brute(rows):
    best = {}
    for n, key, loaded, status, kick, _ in rows:
        if n is None or key is None:
            continue
        v = (status.strip(" ").lower() if status is not None else None, kick)
        order = (loaded is not None, loaded or 0, v[0] is not None, v[0] or "", v[1] is not None, v[1] or 0)
        if (n, key) not in best or order > best[n, key][0]:
            best[n, key] = (order, v)
    ns = sorted({n for n, _ in best})
    out = []
    for a, b in zip(ns, ns[1:], strict=False):
        for key in {k for _, k in best}:
            x, y = best.get((a, key)), best.get((b, key))
            if x and not y:
                out.append((b, key, "removed"))
            elif y and not x:
                out.append((b, key, "added"))
            elif x and y and x[1] != y[1]:
                out.append((b, key, "changed"))
    return sorted(out)


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_against_brute_force(spark, chunk_rows):
    r = random.Random(chunk_rows)
    rows = []
    for n in (1, 2, 3, 5):
        for k in range(80):
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                rows.append((n, f"k{k}", r.choice([None, 1, 2, 3]), r.choice([" NS", "ns", "FT", None, ""]) if r.random() < 0.2 else "NS", k if r.random() < 0.95 else None, "clash"))
    rows += [(None, "k1", 1, "x", 1, ""), (2, None, 1, "x", 1, "")]
    got = changes(spark.createDataFrame(rows, S), chunk_rows=chunk_rows, ranges=4)
    assert sorted((x.snapshot, x.key, x.change_kind) for x in got.collect()) == brute(rows)


def test_changed_fields_and_repeats(spark):
    rows = [(1, "a", 1, "NS", 5, ""), (1, "a", 1, "NS", 5, ""), (2, "a", 1, "ns ", 6, "")]
    (r,) = changes(spark.createDataFrame(rows, S)).collect()
    assert (r.change_kind, r.changed_fields) == ("changed", ["kick"])


def test_one_or_no_snapshot(spark):
    assert changes(spark.createDataFrame([(1, "a", 1, "NS", 5, "")], S)).count() == 0
    assert changes(spark.createDataFrame([], S)).count() == 0
