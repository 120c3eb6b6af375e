import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.functions import text as X
from tidemark.operators import asof, checks, context, fit, grid, joins, ledger, linking, shares, stats, targets
from tidemark.sources import loaders, readers


def test_in_keys_and_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, k string")
    assert [r.id for r in joins.in_keys(df, "k", ["a", "a", None, "z"]).collect()] == [1]
    table = spark.createDataFrame([("a", 7), ("b", 8)], "k string, v long")
    assert joins.lookup(df.where("k is not null"), table, ["k"]).count() == 2
    with pytest.raises(checks.CheckFailed):
        joins.lookup(df.where("id = 1"), table.where("v = 8"), ["k"])
    with pytest.raises(checks.CheckFailed):
        joins.lookup(df.where("id = 1"), table.unionAll(table), ["k"])


def test_questions(spark):
    rows = [("Will Alpha FC win on 2026-07-20?", "win", "home", None), ("Spread: Beta (-1.5)", "handicap", "away", 1.5), ("Alpha FC vs. Beta: Beta O/U 1.5", "team_total", "away", 1.5), ("Alpha FC vs. Beta: O/U 2.5", "total", None, 2.5), ("Will Gamma win on 2026-07-20?", None, None, None), ("Alpha FC vs. Beta: O/U many", None, None, None), (None, None, None, None), ("", None, None, None), ("Exact Score: Alpha FC 2 - 1 Beta?", "exact", None, None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, q string").select("i", X.market_question(F.col("q"), F.lit("Alpha FC"), F.lit("Beta")).alias("x")).orderBy("i")
    assert [(r.x.kind, r.x.side, r.x.line) for r in df.collect()] == [r[1:] for r in rows]
    assert (df.collect()[-1].x.home_score, df.collect()[-1].x.away_score) == (2, 1)


def test_agreement_and_reasons(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 1, 0), ("b", 2, 0), ("c", None, 0), (None, 1, 1)], "k string, h int, a int")
    agreed, conflicts = targets.agreed(df, ["k"], ["h", "a"], [F.count(F.lit(1)).alias("n")])
    assert {(r.k, r.h, r.a, r.n) for r in agreed.collect()} == {("a", 1, 0, 2), (None, 1, 1, 1)}
    assert [(r.k, r.scores, r.observations) for r in conflicts.collect()] == [("b", 2, 2)]
    got = {r.k: r.outcome for r in targets.agreement(df.where("k is not null"), ["k"], F.col("h").isNotNull(), ["h", "a"]).collect()}
    assert got == {"a": "target", "b": "conflict", "c": "no_valid_artifact"}
    assert df.select(targets.first_reason({"x": F.col("h") > 1, "y": F.col("k").isNull()}).alias("r")).groupBy("r").count().count() == 3


def test_recent_form_against_brute_force(spark):
    r = random.Random(5)
    rows = [(f"e{i}", r.choice("xyz"), r.randrange(40), r.randrange(3), r.randrange(3)) for i in range(80)]
    rows = [(e, t, k, k + r.randrange(1, 9), s, c) for e, t, k, s, c in rows]
    got = {(x.event, x.team): (x.played, x.points, x.scored, x.form) for x in context.recent_form(spark.createDataFrame(rows, "event string, team string, k long, known long, s long, c long"), "team", "event", "k", "known", "s", "c", 5).collect()}
    want = {}
    for e, t, k, *_ in rows:
        before = sorted((x for x in rows if x[1] == t and x[3] < k), key=lambda x: (x[3], x[2], x[0]), reverse=True)[:5]
        if before:
            letters = ["W" if x[4] > x[5] else "D" if x[4] == x[5] else "L" for x in before]
            want[e, t] = (len(before), sum({"W": 3, "D": 1, "L": 0}[y] for y in letters), sum(x[4] for x in before), "".join(letters))
    assert got == want


def test_capped_shares_against_filling_round_by_round(spark):
    r = random.Random(3)
    rows = [(g, i, r.choice([None, 0.0, 1.0, 2.0, 9.0, 50.0])) for g in range(40) for i in range(r.randrange(1, 8))]
    got = defaultdict(dict)
    for x in shares.capped(spark.createDataFrame(rows, "g int, i int, w double"), ["g"], "w", ["i"], 0.4).collect():
        got[x.g][x.i] = x.share
    for g, of in got.items():
        w = {i: (v or 0.0) for k, i, v in rows if k == g}
        cap, share = max(0.4, 1 / len(w)), dict.fromkeys(w, 0.0)
        fixed = set()
        while True:
            rest, left = sum(v for i, v in w.items() if i not in fixed), 1 - cap * len(fixed)
            share = {i: cap if i in fixed else (v * left / rest if rest else 0.0) for i, v in w.items()}
            over = {i for i in w if i not in fixed and share[i] > cap + 1e-9}
            if not over:
                break
            fixed |= over
        assert of == pytest.approx(share)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + r.randrange(20)) for i in range(20)] + [(500, 500), (None, 3)]
    got = {x.node: x.component for x in linking.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in label:
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert linking.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lifecycle(spark):
    there = {1: "ab", 2: "b", 4: "a", 7: "ab"}
    rows = [(d, e, "x" if e in s else "") for d, s in there.items() for e in "ab"]
    got = {tuple(x) for x in checks.lifecycle(spark.createDataFrame(rows, "d int, e string, v string"), "d", "e", {"r": F.col("v") == "x"}).collect()}
    assert got == {("r", "a", 1, "opened"), ("r", "a", 2, "resolved"), ("r", "a", 3, "reopened"), ("r", "b", 1, "opened"), ("r", "b", 3, "resolved"), ("r", "b", 4, "reopened")}


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = ledger.commit(spark, path, [{"k": "é", "v": 1}, {"k": "b", "v": None}])
    assert ledger.commit(spark, path, []) == first != ledger.commit(spark, path, [{"k": "c", "v": 3}])
    assert sorted((r.k, r.v) for r in ledger.read(spark, path, "k string, v long").collect()) == [("b", None), ("c", 3), ("é", 1)]
    file = tmp_path / "ledger" / "000000000.jsonl"
    (tmp_path / "ledger" / ".000000000.jsonl.crc").unlink(missing_ok=True)
    file.write_text(file.read_text().replace('"v":1', '"v":2'))
    with pytest.raises(checks.CheckFailed):
        ledger.read(spark, path, "k string, v long")


def test_tilt_and_biases(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(r.uniform(0.8, 2)), float(r.uniform(0.8, 2)), int(r.poisson(2.0)), int(r.poisson(0.9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, rh double, ra double, y int, x int").where("y <= 12 and x <= 12")
    cells = grid.score_rows(df, ["id", "y", "x"], F.col("rh"), F.col("ra"), F.lit(0.0)).persist()
    weights, means = fit.fit_tilt(cells, ["id"], {"h": F.col("h").cast("double"), "a": F.col("a").cast("double")}, {"h": F.col("y").cast("double"), "a": F.col("x").cast("double")})
    assert weights["h"] > 0.1 > 0 > weights["a"]
    assert means == pytest.approx({"h": np.mean([x[3] for x in rows]), "a": np.mean([x[4] for x in rows])}, abs=1e-6)
    tilted = grid.tilted(cells, ["id"], {"h": F.col("h").cast("double"), "a": F.col("a").cast("double")}, weights)
    assert tilted.groupBy("id").agg(F.sum(F.col("h") * F.col("p")).alias("m")).agg(F.avg("m")).first()[0] == pytest.approx(means["h"], abs=1e-6)
    p = spark.createDataFrame([(i % 3 if i % 2 else 0, 0.3, 0.3, 0.4) for i in range(60)], "y int, a double, b double, c double")
    bias, fitted = fit.fit_biases(p, ["a", "b", "c"], "y")
    assert fitted == pytest.approx([r[1] / 60 for r in sorted(p.groupBy("y").count().collect())], abs=1e-9) and bias[0] == 0
    assert fit.fit_biases(p.where("y = 0"), ["a", "b", "c"], "y")[1] == pytest.approx([1, 0, 0], abs=1e-6)
    with pytest.raises(fit.NotConverged):
        fit.fit_biases(p, ["a", "b", "c"], "y", steps=1)


def test_distributions(spark):
    df = spark.range(1).select(*[P.negative_binomial(F.lit(k), F.lit(4.7), F.lit(8.0)).alias(f"k{k}") for k in (0, 1, 7)], P.negative_binomial(F.lit(1), F.lit(0.0), F.lit(1.0)).alias("none"), P.poisson_support(F.lit(2.0), 1e-7, 200).alias("n"), P.poisson_support(F.lit(500.0), 1e-7, 20).alias("beyond"))
    row = df.first()
    want = lambda k: math.exp(math.lgamma(k + 8) - math.lgamma(8) - math.lgamma(k + 1) + 8 * math.log(8 / 12.7) + k * math.log(4.7 / 12.7))
    assert [row.k0, row.k1, row.k7] == pytest.approx([want(0), want(1), want(7)])
    assert row.none is None and row.beyond is None and 8 <= row.n <= 14
    assert {r.bin: r.n for r in stats.dirichlet_bins(spark.createDataFrame([("a", 0), ("a", 2), ("a", None)], "k string, b int"), "k", "b", 3, 1.0).collect()} == {0: 1, 1: 0, 2: 1}


def test_loaders_take_what_is_missing_or_broken(spark):
    docs = spark.createDataFrame([("u/matches/5.json", '{"x": [{"v": 1}, {}]}'), ("u/none", '{"x": [{"v": 2}]}'), ("u/matches/6.json", '{"x": null}'), ("u/matches/7.json", "{"), (None, None)], "url string, body string")
    assert sorted((r.record_id or "", r.ordinal, r.v) for r in loaders.nested_rows(docs, "url", r"/(\d+)\.json", "body", "x", "array<struct<v:int>>").collect() if r.v is not None) == [("", 0, 2), ("5", 0, 1)]
    z = loaders.zipped(spark.createDataFrame([(1, '["a","b"]', '["1"]'), (2, None, "["), (3, "[]", None)], "i int, o string, p string"), {"o": "outcome", "p": "price"})
    assert sorted(tuple(r) for r in z.collect() if r.outcome) == [(1, 0, "a", "1"), (1, 1, "b", None)]
    t = loaders.typed(spark.createDataFrame([('[{"type":"s","value":"3"},{"type":"s","value":"4"}]',), ('[{"type":"s","value":"n/a"}]',), ("x",), (None,)], "j string"), "j", {"s": "bigint"})
    assert [r.s for r in t.collect()] == [4, None, None, None]


def test_checked_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.checked_config(tmp_path / "c.json", {"a": lambda x: x == 1}) == {"a": 1}
    for rules in ({"a": lambda x: x > 1}, {"b": lambda x: True}, {}):
        with pytest.raises(ValueError):
            readers.checked_config(tmp_path / "c.json", rules)


def test_linking_by_name_and_tiers(spark):
    left = spark.createDataFrame([("l1", 100, "oldel town"), ("l2", 100, "mirvor"), ("l3", 100, "")], "l string, t long, n string")
    right = spark.createDataFrame([("r1", 110, "oldel"), ("r2", 115, "oldel town fc"), ("r3", 900, "mirvor"), ("r4", 100, "old")], "r string, t long, n string")
    assert [tuple(x) for x in linking.nearest_by_name(left, right, "l", "r", "t", "n", 50, 10).collect()] == [("l1", "r1", 10, True)]
    assert {tuple(x) for x in linking.tiered(left, right, "l", "r", [["t", "n"], ["t"], ["n"]]).collect()} == {("l1", "r4", 2), ("l2", "r4", 2), ("l3", "r4", 2), ("l2", "r3", 3)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_spans_change_no_asof_join(spark, inclusive):
    r = random.Random(4)
    probes = spark.createDataFrame([(i, r.choice("aab"), r.randrange(-50, 200)) for i in range(80)], "i int, k string, t long")
    builds = spark.createDataFrame([(r.choice("aabc"), r.randrange(-50, 200), i) for i in range(60)], "k string, t long, v int")
    run = lambda **o: sorted(map(tuple, asof.asof_join(probes, builds, ["k"], "t", "t", ["v"], inclusive=inclusive, tie=["v"], **o).collect()))
    assert run() == run(span=7) == run(span=1000) and run(lookback=9) == run(lookback=9, span=5)


def test_windows_over_spans(spark):
    r = random.Random(6)
    rows = [(i, r.choice("aab"), r.randrange(-40, 300), r.choice([None, 1, 2])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, k string, t long, v long")
    back = {x.i: (x.n, x.s) for x in context.looking_back(df, ["k"], "t", {"n": (F.count(F.lit(1)), 10), "s": (F.sum("v"), 25)}).collect()}
    sums = {x.i: (x.s, x.n) for x in context.running_before(df, ["k"], "t", {"s": F.col("v"), "n": F.lit(1)}, 30).collect()}
    last = {x.i: x.last for x in context.last_before(df, ["k"], "t", 30).collect()}
    assert len(back) == len(sums) == len(last) == 120
    for i, k, t, _ in rows:
        mine = [x for x in rows if x[1] == k and x[2] < t]
        within = [x[3] for x in mine if x[2] >= t - 25 and x[3] is not None]
        assert back[i] == (sum(x[2] >= t - 10 for x in mine), sum(within) if within else None)
        assert sums[i] == (sum(x[3] or 0 for x in mine), len(mine))
        assert last[i] == max((x[2] for x in mine), default=None)


@pytest.mark.parametrize("buckets", [2, 64])
def test_exact_quantiles_by_buckets(spark, buckets):
    r = random.Random(8)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([None, 5.0, *(r.random() for _ in range(4))])) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {x.k: (x.n, x.median, x.p90, x.p95, x.max) for x in stats.distribution_summary(df, ["k"], "x", buckets).collect()}
    for k in {k for k, _ in rows}:
        x = [v for y, v in rows if y == k and v is not None]
        if x:
            assert got[k] == pytest.approx((len(x), *np.quantile(x, [0.5, 0.9, 0.95]), max(x)))
        else:
            assert got[k] == (0, None, None, None, None)
