import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import asof, checks, fit, grid, ledger, linking, replay, stats, upsert


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_asof_join_ties_strictness_and_lookback(spark):
    p = spark.createDataFrame([("a", 10, 1), ("a", 4, 2), ("b", 10, 3), (None, 10, 4)], "k string, t long, id int")
    b = spark.createDataFrame([("a", 5, "x", 1), ("a", 10, "y", 1), ("a", 10, "z", 2)], "k string, t long, v string, seq int")
    take = lambda **o: {r.id: r.v for r in asof.asof_join(p, b, ["k"], "t", "t", ["v"], tie=["seq"], **o).collect()}
    assert take() == {1: "z", 2: None, 3: None, 4: None}
    assert take(inclusive=False) == {1: "x", 2: None, 3: None, 4: None}
    assert take(inclusive=False, lookback=4)[1] is None


def test_band_join_and_margin(spark):
    r = random.Random(3)
    a = [(i, r.choice("xy"), r.randrange(300)) for i in range(80)]
    b = [(i, r.choice("xy"), r.randrange(300)) for i in range(80)]
    left, right = spark.createDataFrame(a, "l long, k string, t long"), spark.createDataFrame(b, "r long, k string, t long")
    got = {(x.l, x.r_r) for x in asof.band_join(left, right, ["k"], "t", "t", 7, 3).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and -7 <= y[2] - x[2] <= 3}
    near = {x.l: (x.r, x.ambiguous) for x in asof.nearest_with_margin(left, right, ["k"], "l", "t", "r", "t", 10, 2).collect()}
    for i, k, t in a:
        found = sorted((abs(y[2] - t), y[0]) for y in b if y[1] == k and abs(y[2] - t) <= 10)
        assert near.get(i) == ((found[0][1], len(found) > 1 and found[1][0] - found[0][0] < 2) if found else None)


def test_no_event_between(spark):
    e = spark.createDataFrame([(1, "x", 100), (2, "x", 150), (3, "x", 400)], "id long, k string, t long")
    kept = asof.no_event_between(e.withColumn("cutoff", F.col("t") - 60), "k", "cutoff", "t", "id", e, "t", "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "p", 1), (2, "b", None, 2)], "id int, r string, c string, n int")
    new = spark.createDataFrame([(2, None, "q", 3), (3, "z", None, 1)], "id int, r string, c string, n int")
    got = upsert.upsert(old, new, ["id"], {"r": "replace", "c": "coalesce_old", "n": "increment"})
    assert rows(got) == rows(spark.createDataFrame([(1, "a", "p", 1), (2, None, "q", 5), (3, "z", None, 1)], "id int, r string, c string, n int"))
    with pytest.raises(ValueError, match="unknown policies"):
        upsert.upsert(old, new, ["id"], {"r": "guess"})
    assert upsert.append_first(old, new, ["id"], [F.col("n")]).count() == 3


def test_merge_and_rekey(spark):
    e = spark.createDataFrame([(3, "x", None), (1, "x", None), (2, "x", "blue"), (9, "y", "red")], "id int, name string, colour string")
    merged, mapping = upsert.merge_entities(e, "id", ["name"], ["colour"])
    assert rows(merged.select("name", "id", "colour")) == rows(spark.createDataFrame([("x", 1, "blue"), ("y", 9, "red")], "name string, id int, colour string"))
    facts = spark.createDataFrame([(2, 3), (9, 1)], "a int, b int")
    assert rows(upsert.rekey(facts, mapping, ["a", "b"])) == rows(spark.createDataFrame([(1, 1), (9, 1)], "a int, b int"))


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.9)], "k int, p double")
    with pytest.raises(checks.CheckFailed):
        checks.assert_unique(df, ["k"])
    with pytest.raises(checks.CheckFailed):
        checks.assert_simplex(df, ["k"], "p")
    assert checks.assert_simplex(df.where("k = 1"), ["k"], "p").count() == 2
    with pytest.raises(checks.CheckFailed):
        checks.assert_before(df, "k", 2)


def test_stable_id_is_a_version_5_uuid(spark):
    space = "6f1d4c1e-2f0a-5b7e-9c3d-8a4e5b6c7d80"
    (got,) = spark.createDataFrame([("a", 7)], "x string, y int").select(X.stable_id("team", F.col("x"), F.col("y"), namespace=space)).first()
    assert got == str(uuid.uuid5(uuid.UUID(space), "team|a|7"))


def test_names(spark):
    assert X.normalise("Łukasz Đorđe Ðór Þór Œzil Straße Əli", True) == "lukasz dorde dor thor oezil strasse eli"
    assert X.normalise("A & B  Ünïon-FC") == "a and b union fc"
    pairs = [("a zoubir", "abdellah zoubir", True), ("seol young woo", "young woo seol", True), ("a silva", "b silva", False), ("m sylla", "mamadou sarr", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select(X.compatible_names(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("2.7",), ("-2.7",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(X.whole_number(F.col("t"))).collect()] == [2, -2, None, None, None]
    p = spark.createDataFrame([(20, "16"), (25, "88%"), (10, None)], "n int, a string").select(X.passes_completed(F.col("n"), F.col("a")).alias("x")).collect()
    assert [(r.x.completed, r.x.percent) for r in p] == [(16, 80.0), (22, 88.0), (None, None)]


def test_score_rows_are_distributions(spark):
    df = spark.createDataFrame([(1, 1.4, 1.1, -0.05), (2, 0.3, 3.0, 0.0)], "id int, h double, a double, r double")
    cells = grid.score_rows(df, ["id"], F.col("h"), F.col("a"), F.col("r"))
    checks.assert_simplex(cells, ["id"], "p", 1e-9)
    tilted = grid.tilted(cells, ["id"], {"x": F.col("h").cast("double")}, {"x": 0.2})
    checks.assert_simplex(tilted, ["id"], "p", 1e-9)


def test_decay_over_eras_equals_pairs(spark):
    r = random.Random(5)
    data = [(i, r.choice("ab"), r.randrange(5000), r.choice([None, 1.0, 2.0, 3.0])) for i in range(120)]
    got = replay.decayed_evidence(spark.createDataFrame(data, "id int, k string, t long, x double"), ["k"], "t", "x", 400.0, 1.25, 5.0, 700.0).collect()
    assert len(got) == len(data)
    for g in got:
        past = [(y[3], 2 ** (-(g.t - y[2]) / 400)) for y in data if y[1] == g.k and y[2] < g.t and y[3] is not None]
        w, s = sum(f for _, f in past), sum(x * f for x, f in past)
        assert g.evidence_weight == pytest.approx(w, abs=1e-9)
        assert g.evidence_mean == pytest.approx((5 * 1.25 + s) / (5 + w), abs=1e-9)


def test_replay_never_sees_its_own_or_later_results(spark):
    base = [(i, i % 3, (i + 1) % 3, 0, i * 3000, (i * 7) % 4, i % 2, False) for i in range(30)]
    schema = "fixture_id long, home long, away long, competition long, kick long, home_goals long, away_goals long, neutral boolean"
    changed = [r if r[0] < 20 else (*r[:5], 9, 9, r[7]) for r in base]
    run = lambda data: {r.fixture_id: (r.expected_home, r.expected_away) for r in replay.state_replay(spark.createDataFrame(data, schema), F.lit(0), replay.ReplaySpec()).collect()}
    a, b = run(base), run(changed)
    assert all(a[i] == b[i] for i in range(21)) and a[29] != b[29]
    assert run(base[::-1]) == a


def test_ledger_chain_and_tampering(spark):
    chain = ledger.append([{"m": f"2024-0{i}", "v": i} for i in range(1, 6)])
    schema = "m string, v long, before_sha256 string, own_sha256 string"
    frame = lambda c: spark.createDataFrame([(r["m"], r["v"], r["before_sha256"], r["own_sha256"]) for r in c], schema)
    assert ledger.broken_links(frame(chain), "m").count() == 0
    bad = [dict(r) for r in chain]
    bad[2]["own_sha256"] = "f" * 64
    assert [r.m for r in ledger.broken_links(frame(bad), "m").collect()] == ["2024-04"]


def test_digest_ignores_order_but_counts_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    d = lambda f: ledger.table_digest(f, ["x", "y"]).first().digest
    assert d(df) == d(df.orderBy(F.desc("x")).repartition(3)) != d(df.unionAll(df))


def test_mutual_best(spark):
    pairs = [("g", "a", "x", 200), ("g", "a", "y", 150), ("g", "b", "x", 190), ("g", "b", "y", 180), ("h", "c", "z", 130), ("h", "c", "w", 120)]
    got = linking.mutual_best(spark.createDataFrame(pairs, "g string, l string, r string, s int"), ["g"], "l", "r", "s", 120, 25)
    assert sorted(tuple(r) for r in got.collect()) == []
    clear = [("g", "a", "x", 200), ("g", "a", "y", 150), ("g", "b", "x", 170), ("g", "b", "y", 160)]
    got = linking.mutual_best(spark.createDataFrame(clear, "g string, l string, r string, s int"), ["g"], "l", "r", "s", 120, 25)
    assert sorted((r.l, r.r) for r in got.collect()) == [("a", "x"), ("b", "y")]


def test_evenly_spaced(spark):
    got = [r.i for r in stats.evenly_spaced(spark.range(100).toDF("i"), ["i"], 5).orderBy("i").collect()]
    assert got == [0, 25, 50, 74, 99]


def test_bootstrap_repeats(spark):
    df = spark.createDataFrame([(f"m{i % 6}", float(i % 5) - 2.1) for i in range(60)], "m string, d double")
    a, b = (stats.block_bootstrap(df, "m", "d", 50, 1).first() for _ in range(2))
    assert a == b and a.low <= a.mean <= a.high


def test_fits(spark):
    df = spark.createDataFrame([(i % 2, 1.0 if i % 2 else -1.0) for i in range(40)] + [(3, 1.0)] * 10, "y int, x double")
    (b,) = fit.fit_poisson(df, "y", F.lit(0.0), [F.col("x")], ridge=0.1)
    assert b > 0


def test_tilts_join_no_cells(spark):
    """Cells joined with their sums were broadcast, which took the driver's memory."""
    base = spark.createDataFrame([(1, 1.3, 0.9), (2, 2.1, 1.7), (3, 0.4, 0.2)], "id long, x double, y double")
    cells = grid.score_rows(base, ["id"], F.col("x"), F.col("y"), F.lit(0.0)).withColumn("r", F.col("h") > F.col("a"))
    args = (["id"], {"h": F.col("h").cast("double")}, {"h": 0.2})
    for within in (["r"], []):
        whole = grid.tilted(cells, *args, within)
        sums = grid.tilted_sums(cells, *args, {"m": F.col("h"), "w": F.when(F.col("r"), 1.0)}, within)
        want = {x.id: (x.m, x.w) for x in whole.groupBy("id").agg(F.sum(F.col("h") * F.col("p")).alias("m"), F.sum(F.when(F.col("r"), F.col("p"))).alias("w")).collect()}
        got = {x.id: (x.m, x.w) for x in sums.collect()}
        assert set(got) == set(want) and all(abs(a - b) < 1e-12 for i in want for a, b in zip(got[i], want[i], strict=True))
        for df in (whole, sums):
            assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
