"""Registered queries on evaluation and fits: walk-forward parameters, grids and their metrics, calibration, shares, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.operators import asof, fit, grid, shares, stats
from tidemark.operators.targets import agreed
from tidemark.plans.modelling import CELLS, POOLED, PROBS, TAU
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.relational import mean_micro, micro

R = Registry()
query = R.query
M6 = "cast(floor({0} * 1e6 + 0.5) as bigint)"
WF = "walk_forward_prediction"


@query(f"select information_state, count(*) n, {M6.format('(125 + sum(home_goals)) / (125 + sum(expected_home_goals))')} home_scale, {M6.format('(125 + sum(away_goals)) / (125 + sum(expected_away_goals))')} away_scale from {WF} group by 1")
def scale_refit(t: Tables) -> DataFrame:
    scale = lambda s: F.floor((125 + F.sum(f"{s}_goals")) / (125 + F.sum(f"expected_{s}_goals")) * 1e6 + 0.5).cast("bigint").alias(f"{s}_scale")
    return t.walk_forward_prediction.groupBy("information_state").agg(F.count(F.lit(1)).alias("n"), scale("home"), scale("away"))


_S = "case when home_goals = 0 and away_goals = 0 then -expected_home_goals * expected_away_goals when home_goals = 0 and away_goals = 1 then expected_home_goals when home_goals = 1 and away_goals = 0 then expected_away_goals when home_goals = 1 and away_goals = 1 then -1 else 0 end"


@query(f"""with s as (select prediction_id, model_key, information_state, epoch_us(kickoff) k, {_S} s from {WF}), r as (select prediction_id, count(*) over w n, sum(s) over w g, sum(s * s) over w h from s window w as (partition by model_key, information_state order by k range between unbounded preceding and 1 preceding))
    select prediction_id, n before, n >= 20 warm, case when n >= 20 then {M6.format('greatest(-0.2, least(0.2, g / (50 + h)))')} else 0 end rho from r""")
def walk_forward_rho(t: Tables) -> DataFrame:
    """The low-score dependence as known before each match: one Newton step from none over all earlier matches, whose
    sums run over a window; nothing before the warm-up."""
    p = t.walk_forward_prediction.withColumn("k", F.unix_micros("kickoff")).withColumn("s", P.low_score_gradient(F.col("home_goals"), F.col("away_goals"), F.col("expected_home_goals"), F.col("expected_away_goals")))
    w = W.partitionBy("model_key", "information_state").orderBy("k").rangeBetween(W.unboundedPreceding, -1)
    r = p.select("prediction_id", F.count(F.lit(1)).over(w).alias("before"), P.clamp(F.sum("s").over(w) / (50 + F.sum(F.col("s") * F.col("s")).over(w)), -0.2, 0.2).alias("r"))
    return r.select("prediction_id", "before", (F.col("before") >= 20).alias("warm"), F.when(F.col("before") >= 20, micro("r")).otherwise(0).alias("rho"))


def _cells(t: Tables, *keep: str) -> DataFrame:
    return grid.score_rows(t.walk_forward_prediction, ["prediction_id", *keep], F.col("expected_home_goals"), F.col("expected_away_goals"), F.col("dixon_coles_rho"))


_GRID = f"{CELLS.format(tau=TAU)}, z as (select prediction_id, sum(p) z from cells group by 1), g as (select prediction_id, h, a, p / z p from cells join z using (prediction_id))"


@query(f"with {_GRID}, e as (select prediction_id, h, a, exp(ln(p) / 1.1) q from g) select prediction_id, h home, a away, {M6.format('q / sum(q) over (partition by prediction_id)')} p from e")
def tempered_grid(t: Tables) -> DataFrame:
    """All 169 cells of every grid at a temperature."""
    return grid.tempered_cells(_cells(t), ["prediction_id"], 1.1).select("prediction_id", F.col("h").cast("long").alias("home"), F.col("a").cast("long").alias("away"), micro("p").alias("p"))


@query(f"with {_GRID} select prediction_id, sha256(string_agg(cast({M6.format('p')} as varchar), ',' order by h, a)) grid_sha256, {M6.format('sum(p * h)')} home_mean, {M6.format('sum(p * a)')} away_mean, {M6.format('sum(p) filter (where h > 0 and a > 0)')} both_score from g group by 1")
def grid_digests(t: Tables) -> DataFrame:
    """Marginal summaries of every grid and a hash of its cells, rounded to millionths."""
    cells = _cells(t)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "a", micro("p").alias("m")))), lambda x: x["m"].cast("string")), ",")
    part = lambda c: F.floor(F.sum(c) * 1e6 + 0.5).cast("bigint")
    return cells.groupBy("prediction_id").agg(F.sha2(told, 256).alias("grid_sha256"), part(F.col("p") * F.col("h")).alias("home_mean"), part(F.col("p") * F.col("a")).alias("away_mean"), part(F.when((F.col("h") > 0) & (F.col("a") > 0), F.col("p"))).alias("both_score"))


_Y = f"(select prediction_id, home_goals y, away_goals x from {WF})"


@query(f"""with {_GRID}, c as (select g.*, y, x, row_number() over (partition by prediction_id order by {M6.format('p')} desc, h, a) rn from g join {_Y} using (prediction_id)),
    t as (select prediction_id, h + a k, sum(p) p, any_value(y + x) s from g join {_Y} using (prediction_id) group by all), f as (select prediction_id, k, s, sum(p) over (partition by prediction_id order by k) f from t), r as (select prediction_id, sum(pow(f - (s <= k)::int, 2)) rps from f group by 1),
    m as (select prediction_id, any_value(y) y, any_value(x) x, sum(p) filter (where h = y and a = x) e, sum(p) filter (where h = y) hm, sum(p) filter (where a = x) am, sum(p) filter (where h + a = y + x) tm, sum(p) filter (where h - a = y - x) dm, sum(p) filter (where sign(h - a) = sign(y - x)) om,
      sum(p) filter (where h > a) w, sum(p) filter (where h = a) d, sum(p) filter (where h < a) l, sum(p) filter (where h > 0 and a > 0) b, sum(p) filter (where h + a > 2) o, max(case when rn = 1 then (h = y and a = x)::int end) hit from c group by 1)
    select model_key, count(*) n, {", ".join(f"{M6.format(f'avg(-ln(greatest(coalesce({c}, 0), 1e-15)))')} {n}" for c, n in (("e", "exact"), ("hm", "home"), ("am", "away"), ("tm", "total"), ("dm", "difference"), ("om", "outcome")))},
    {M6.format('avg(pow(w - (y > x)::int, 2) + pow(d - (y = x)::int, 2) + pow(l - (y < x)::int, 2))')} outcome_brier, {M6.format('avg(pow(b - (y > 0 and x > 0)::int, 2))')} both_score_brier, {M6.format('avg(pow(o - (y + x > 2)::int, 2))')} over_brier, {M6.format('avg(rps)')} total_rps, {M6.format('avg(hit)')} top_hit
    from m join r using (prediction_id) join {WF} using (prediction_id) group by model_key""")
def grid_metrics(t: Tables) -> DataFrame:
    """Eleven metrics of score grids by model."""
    return grid.metrics(_cells(t, "model_key", "home_goals", "away_goals"), ["model_key", "prediction_id"], "home_goals", "away_goals", ["model_key"])


@query(f"select 'home' feature, {M6.format('avg(home_goals)')} fitted from {WF} where home_goals <= 12 and away_goals <= 12 union all select 'away', {M6.format('avg(away_goals)')} from {WF} where home_goals <= 12 and away_goals <= 12 union all select 'draw', {M6.format('avg((home_goals = away_goals)::int)')} from {WF} where home_goals <= 12 and away_goals <= 12")
def tilt_fit(t: Tables) -> DataFrame:
    """Feature means under the fitted exponential tilt, which at the optimum are those of the observed scores."""
    cells = _cells(t, "home_goals", "away_goals").where("home_goals <= 12 and away_goals <= 12")
    features = lambda h, a: {"home": h.cast("double"), "away": a.cast("double"), "draw": (h == a).cast("double")}
    _, means = fit.fit_tilt(cells, ["prediction_id"], features(F.col("h"), F.col("a")), features(F.col("home_goals"), F.col("away_goals")))
    return t.spark.createDataFrame([(k, int(v * 1e6 + 0.5)) for k, v in means.items()], "feature string, fitted long")


@query(f"with o as (select result, count(*) * 1.0 / (select count(*) from {WF}) f from {WF} group by 1) select result outcome, {M6.format('f')} fitted from o")
def vector_calibration(t: Tables) -> DataFrame:
    """Mean calibrated probabilities after a bias for each class is fitted, which then are the observed shares."""
    y = F.when(F.col("result") == "home_win", 0).when(F.col("result") == "draw", 1).otherwise(2)
    means = fit.fit_biases(t.walk_forward_prediction.select(y.alias("y"), *PROBS.values()), list(PROBS.values()), "y")[1]
    return t.spark.createDataFrame([(k, int(m * 1e6 + 0.5)) for k, m in zip(PROBS, means, strict=True)], "outcome string, fitted long")


SHAPES = (2.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 40.0, 80.0)
_NB = "lgamma({k} + {r}) - lgamma({r}) - lgamma({k} + 1) + {r} * ln({r} / ({r} + {m})) + {k} * ln({m} / ({r} + {m}))"


@query(f"with r as (select unnest({list(SHAPES)})::double r), m as (select avg(total_corners) m from corner_target) select r shape, cast(floor(sum({_NB.format(k='total_corners', r='r', m='m')}) * 1e3 + 0.5) as bigint) log_likelihood from corner_target, r, m group by r")
def corner_shape_profile(t: Tables) -> DataFrame:
    """The likelihood of each shape of the corner distribution, from counts of equal totals."""
    return fit.shape_profile(t.corner_target, "total_corners", SHAPES).select("shape", F.floor(F.col("log_likelihood") * 1e3 + 0.5).cast("bigint").alias("log_likelihood"))


@query(f"with h as (select i.range k, exp({_NB.format(k='i.range', r='9.0', m='5.6')}) p from range(61) i), a as (select i.range k, exp({_NB.format(k='i.range', r='8.0', m='4.7')}) p from range(61) i) select h.k + a.k total, {M6.format('sum(h.p * a.p)')} p from h, a where h.k + a.k <= 60 group by 1")
def corner_totals(t: Tables) -> DataFrame:
    """The distribution of the sum of two counts."""
    return grid.convolved(t.spark.range(1), lambda k: P.negative_binomial(k, F.lit(5.6), F.lit(9.0)), lambda k: P.negative_binomial(k, F.lit(4.7), F.lit(8.0)), 60).select(F.col("k").cast("long").alias("total"), micro("p").alias("p"))


@query("with r as (select distinct home_corners + 0.5 m from corner_target), c as (select m, i.range k, sum(exp(-m + i.range * ln(m) - lgamma(i.range + 1))) over (partition by m order by i.range) f from r, range(200) i) select m mean, min(k) filter (where f >= 1 - 1e-7) support from c group by 1")
def growing_support(t: Tables) -> DataFrame:
    """How far a distribution must be summed to leave out next to nothing."""
    means = t.corner_target.select((F.col("home_corners") + 0.5).cast("double").alias("mean")).distinct()
    return means.select("mean", P.poisson_support(F.col("mean"), 1e-7, 200).cast("long").alias("support"))


@query(f"with p as (select l_returnflag pos, avg(l_discount) m from lineitem group by 1), s as (select l_suppkey, l_returnflag pos, avg(l_discount) d, count(*) n from lineitem group by all) select l_suppkey, pos, n, {M6.format('(60 * m + n * d) / (60 + n)')} shrunk from s join p using (pos)")
def position_shrinkage(t: Tables) -> DataFrame:
    """Rates shrunk to the mean of their position."""
    return stats.shrunk(t.lineitem.select("l_suppkey", F.col("l_returnflag").alias("pos"), "l_discount"), ["l_suppkey"], "pos", "l_discount", 60.0).select("l_suppkey", "pos", "n", micro("shrunk").alias("shrunk"))


@query(f"with b as (select l_returnflag pos, least(floor(l_quantity / 10), 4)::bigint bin, count(*) n from lineitem group by all), g as (select pos, x.range bin from (select distinct l_returnflag pos from lineitem), range(5) x) select pos, bin, {M6.format('(2 + coalesce(n, 0)) / (10 + sum(coalesce(n, 0)) over (partition by pos))')} p from g left join b using (pos, bin)")
def minute_bins(t: Tables) -> DataFrame:
    """Shares of bins with a Dirichlet prior; bins without a row are there, too."""
    return stats.dirichlet_bins(t.lineitem.select(F.col("l_returnflag").alias("pos"), F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).alias("bin")), "pos", "bin", 5, 2.0).select("pos", F.col("bin").cast("long").alias("bin"), micro("p").alias("p"))


@query(f"""with w as (select l_orderkey o, l_linenumber i, l_partkey q, l_quantity w, count(*) over (partition by l_orderkey) n, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) r from lineitem),
    s as (select *, sum(w) over (partition by o order by r rows between current row and unbounded following) s, greatest(0.4, 1.0 / n) c from w), k as (select *, count(*) filter (where w * (1 - c * (r - 1)) > c * s + 1e-9) over (partition by o) j from s), u as (select *, sum(w) filter (where r > j) over (partition by o) rest from k)
    select o l_orderkey, i l_linenumber, q l_partkey, {M6.format('case when r <= j then c else w * (1 - c * j) / rest end')} share from u""")
def capped_shares(t: Tables) -> DataFrame:
    """Shares of a whole by weight of which none is above a cap; what is cut off fills up the others."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return shares.capped(rows, ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey"], 0.4).select("l_orderkey", "l_linenumber", "l_partkey", micro("share").alias("share"))


@query(f"with {POOLED.replace('select model_key,', 'select fold_key, model_key,')} select substr(fold_key, 1, 4) fold, cast(least(floor(p * 10), 9) as bigint) bin, count(*) n, {M6.format('avg(p)')} mean_probability, {M6.format('avg(hit)')} hit_rate from pool group by all")
def yearly_fold_bins(t: Tables) -> DataFrame:
    each = F.array(*[F.struct(F.col(c).alias("p"), (F.col("result") == k).cast("int").alias("hit")) for k, c in PROBS.items()])
    pool = t.walk_forward_prediction.select(F.substring("fold_key", 1, 4).alias("fold"), F.explode(each).alias("x")).select("fold", "x.*")
    return pool.groupBy("fold", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), mean_micro("p").alias("mean_probability"), mean_micro("hit").alias("hit_rate"))


@query(f"""select model_key, sha256('{{"away_scale":' || {M6.format('avg(away_rate_scale)')} || ',"home_scale":' || {M6.format('avg(home_rate_scale)')} || ',"model":"' || model_key || '","rho":' || {M6.format('avg(dixon_coles_rho)')} || '}}') sha256 from {WF} group by 1""")
def model_digests(t: Tables) -> DataFrame:
    """A model's parameters as canonical JSON, sorted and rounded, and their hash."""
    per = t.walk_forward_prediction.groupBy("model_key").agg(mean_micro("away_rate_scale").alias("away_scale"), mean_micro("home_rate_scale").alias("home_scale"), mean_micro("dixon_coles_rho").alias("rho"))
    return per.select("model_key", F.sha2(F.to_json(F.struct("away_scale", "home_scale", F.col("model_key").alias("model"), "rho")), 256).alias("sha256"))


@query(f"""with t as (select fixture_id, min(home_goals) h, min(away_goals) a from score_target where home_goals is not null and away_goals is not null group by 1 having count(distinct home_goals * 1000 + away_goals) = 1),
    j as (select p.information_state s, p.home_goals = t.h and p.away_goals = t.a same, moneyline_log_loss - ln(3) d, moneyline_brier - 2.0 / 3 b from {WF} p join t using (fixture_id))
    select s information_state, count(*) n, count(*) filter (where not same) differing, {M6.format('avg(d)')} log_loss_delta, {M6.format('avg(b)')} brier_delta from j group by 1""")
def retrospective_audit(t: Tables) -> DataFrame:
    """Predictions joined to agreed targets: how many scores differ, and the losses against a coin of three sides."""
    target, _ = agreed(t.score_target, ["fixture_id"], ["home_goals", "away_goals"], [])
    j = t.walk_forward_prediction.join(target.toDF("fixture_id", "h", "a"), "fixture_id").select("information_state", ((F.col("home_goals") == F.col("h")) & (F.col("away_goals") == F.col("a"))).alias("same"), (F.col("moneyline_log_loss") - F.ln(F.lit(3.0))).alias("d"), (F.col("moneyline_brier") - 2.0 / 3).alias("b"))
    return j.groupBy("information_state").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("same")).alias("differing"), mean_micro("d").alias("log_loss_delta"), mean_micro("b").alias("brier_delta"))


_DELTAS = f"""with m as (select model_key, information_state, avg(exact_score_log_loss) l, avg(moneyline_brier) b, count(*) n from {WF} group by all), z as (select information_state, l, b from m where model_key = (select min(model_key) from {WF})),
    d as (select model_key, information_state, m.l - z.l dl, m.b - z.b db, n from m join z using (information_state) where model_key <> (select min(model_key) from {WF}))"""


def _deltas(t: Tables) -> DataFrame:
    """Each candidate's losses less those of the first model, by horizon: a row each."""
    m = t.walk_forward_prediction.groupBy("model_key", "information_state").agg(F.avg("exact_score_log_loss").alias("l"), F.avg("moneyline_brier").alias("b"), F.count(F.lit(1)).alias("n"))
    m = m.join(t.walk_forward_prediction.agg(F.min("model_key").alias("base")), F.lit(True))
    z = m.where("model_key = base").select("information_state", F.col("l").alias("zl"), F.col("b").alias("zb"))
    return m.where("model_key <> base").join(z, "information_state").select("model_key", "information_state", (F.col("l") - F.col("zl")).alias("dl"), (F.col("b") - F.col("zb")).alias("db"), "n")


@query(_DELTAS + f" select model_key, {M6.format('sum(dl)')} total_delta, bool_and(dl < 0) better_everywhere, row_number() over (order by bool_and(dl < 0) desc, {M6.format('sum(dl)')}, {M6.format('sum(db)')}, model_key) place from d group by 1")
def candidate_selection(t: Tables) -> DataFrame:
    """Candidates that are better at every horizon come first, then by their summed losses."""
    per = _deltas(t).groupBy("model_key").agg(F.floor(F.sum("dl") * 1e6 + 0.5).cast("bigint").alias("total_delta"), F.floor(F.sum("db") * 1e6 + 0.5).cast("bigint").alias("b"), F.bool_and(F.col("dl") < 0).alias("better_everywhere"))
    place = F.row_number().over(W.orderBy(F.desc("better_everywhere"), "total_delta", "b", "model_key"))  # one row a model
    return per.select("model_key", "total_delta", "better_everywhere", place.cast("long").alias("place"))


@query(_DELTAS + " select model_key, information_state, n, concat_ws(',', case when n < 30 then 'few_matches' end, case when dl >= 0 then 'log_loss_not_lower' end, case when db > 0.001 then 'brier_higher' end) failed from d")
def selection_gates(t: Tables) -> DataFrame:
    """Which gates of promotion each candidate fails at each horizon."""
    failed = F.concat_ws(",", F.when(F.col("n") < 30, "few_matches"), F.when(F.col("dl") >= 0, "log_loss_not_lower"), F.when(F.col("db") > 0.001, "brier_higher"))
    return _deltas(t).select("model_key", "information_state", "n", failed.alias("failed"))


@query("""select p.prediction_id, concat_ws(',', case when f.fixture_id is null then 'no_features' end, case when f.home_xg_attack is null and f.fixture_id is not null then 'no_xg' end, case when f.home_xg_history < 5 then 'short_history' end, case when p.training_fixtures < 1000 then 'few_training_fixtures' end) warnings
    from walk_forward_prediction p left join (select fixture_id, information_state, min(feature_row_id) i from rich_rate_feature group by all) g on g.fixture_id = p.fixture_id and g.information_state = p.information_state left join rich_rate_feature f on f.feature_row_id = g.i""")
def prediction_warnings(t: Tables) -> DataFrame:
    """Predictions with what speaks against relying on them."""
    f = t.rich_rate_feature.groupBy("fixture_id", "information_state").agg(F.min(F.struct("feature_row_id", "home_xg_attack", "home_xg_history")).alias("f"))
    said = F.concat_ws(",", F.when(F.col("f").isNull(), "no_features"), F.when(F.col("f").isNotNull() & F.col("f.home_xg_attack").isNull(), "no_xg"), F.when(F.col("f.home_xg_history") < 5, "short_history"), F.when(F.col("training_fixtures") < 1000, "few_training_fixtures"))
    return t.walk_forward_prediction.select("prediction_id", "fixture_id", "information_state", "training_fixtures").join(f, ["fixture_id", "information_state"], "left").select("prediction_id", said.alias("warnings"))


@query(f"""with p as (select fixture_id, information_state, max(prediction_id) prediction_id, max(epoch_us(prediction_at)) as_of from {WF} group by all), f as (select fixture_id, information_state, max(feature_row_id) feature_row_id from rich_rate_feature group by all),
    q as (select p.fixture_id, p.information_state, max(quote_id) quote_id from p join external_market_quote x on x.fixture_id = p.fixture_id and epoch_us(observed_at) < as_of group by all),
    r as (select p.fixture_id, p.information_state, max(target_row_id) target_row_id from p join score_target s on s.fixture_id = p.fixture_id and epoch_us(result_available_at) < as_of group by all)
    select p.fixture_id, p.information_state, prediction_id, feature_row_id, quote_id, target_row_id, concat_ws(',', case when feature_row_id is null then 'features' end, case when quote_id is null then 'market' end) missing from p left join f using (fixture_id, information_state) left join q using (fixture_id, information_state) left join r using (fixture_id, information_state)""")
def family_snapshot(t: Tables) -> DataFrame:
    """The latest of every family for each fixture and horizon, as far as it was known by then, and what is missing."""
    key = ["fixture_id", "information_state"]
    p = t.walk_forward_prediction.groupBy(*key).agg(F.max("prediction_id").alias("prediction_id"), F.unix_micros(F.max("prediction_at")).alias("as_of"))
    f = t.rich_rate_feature.groupBy(*key).agg(F.max("feature_row_id").alias("feature_row_id"))
    known = lambda df, at, i: p.select(*key, "as_of").join(df.where(F.col(at).isNotNull()).select("fixture_id", F.unix_micros(at).alias("at"), i), "fixture_id").where("at < as_of").groupBy(*key).agg(F.max(i).alias(i))
    out = p.join(f, key, "left").join(known(t.external_market_quote, "observed_at", "quote_id"), key, "left").join(known(t.score_target, "result_available_at", "target_row_id"), key, "left")
    return out.select(*key, "prediction_id", "feature_row_id", "quote_id", "target_row_id", F.concat_ws(",", F.when(F.col("feature_row_id").isNull(), "features"), F.when(F.col("quote_id").isNull(), "market")).alias("missing"))


_PREDICATES = {"probabilities_sum": "abs(home_win_probability + draw_probability + away_win_probability - 1) > 0.001", "positive_rates": "expected_home_goals <= 0 or expected_away_goals <= 0", "before_kickoff": "prediction_at >= kickoff", "known_result": "result not in ('home_win', 'draw', 'away_win')", "rho_in_range": "abs(dixon_coles_rho) > 0.2"}


@query(" union all ".join(f"select '{k}' predicate, count(*) filter (where {c}) violations, count(*) n from {WF}" for k, c in _PREDICATES.items()))
def snapshot_structure(t: Tables) -> DataFrame:
    """All predicates of a snapshot's structure in one scan."""
    one = t.walk_forward_prediction.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in _PREDICATES.items()])
    return one.unpivot(["n"], list(_PREDICATES), "predicate", "violations").select("predicate", "violations", "n")


@query(f"""with p as (select fixture_id, arg_max(result, prediction_id) result, arg_max(home_win_probability, prediction_id) h, arg_max(draw_probability, prediction_id) d, arg_max(away_win_probability, prediction_id) a from {WF} group by 1),
    j as (select source, market_probability m, case selection when 'home_win' then h when 'draw' then d else a end p, (selection = result)::int y from external_market_quote join p using (fixture_id) where market_probability is not null and selection in ('home_win', 'draw', 'away_win'))
    select source, count(*) n, {M6.format('avg(abs(m - p))')} mean_distance, {M6.format('avg(pow(m - y, 2))')} market_brier, {M6.format('avg(pow(p - y, 2))')} model_brier, {M6.format('avg((abs(m - y) < abs(p - y))::int)')} market_closer, {M6.format('avg(m - y)')} market_bias from j group by 1""")
def market_report(t: Tables) -> DataFrame:
    """Five questions on each source of quotes against the model and the results."""
    p = t.walk_forward_prediction.groupBy("fixture_id").agg(F.max_by(F.struct("result", *PROBS.values()), "prediction_id").alias("p"))
    picked = F.coalesce(*[F.when(F.col("selection") == k, F.col(f"p.{c}")) for k, c in PROBS.items()])
    j = t.external_market_quote.where("market_probability is not null and selection in ('home_win', 'draw', 'away_win')").select("fixture_id", "source", "selection", F.col("market_probability").alias("m")).join(p, "fixture_id").select("source", "m", picked.alias("q"), (F.col("selection") == F.col("p.result")).cast("int").alias("y"))
    mean = lambda c, name: F.floor(F.avg(c) * 1e6 + 0.5).cast("bigint").alias(name)
    m, q, y = F.col("m"), F.col("q"), F.col("y")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), mean(F.abs(m - q), "mean_distance"), mean((m - y) * (m - y), "market_brier"), mean((q - y) * (q - y), "model_brier"), mean((F.abs(m - y) < F.abs(q - y)).cast("int"), "market_closer"), mean(m - y, "market_bias"))


@query(f"with g as (select unnest(range(60, 161)) / 100.0 temp), e as (select information_state s, g.temp, -ln(greatest(exp(ln(greatest(case result when 'home_win' then home_win_probability when 'draw' then draw_probability else away_win_probability end, 1e-15)) / temp) / (exp(ln(greatest(home_win_probability, 1e-15)) / temp) + exp(ln(greatest(draw_probability, 1e-15)) / temp) + exp(ln(greatest(away_win_probability, 1e-15)) / temp)), 1e-15)) l from {WF}, g), m as (select s, temp, avg(l) l from e group by all) select s information_state, cast(round(arg_min(temp, l) * 100) as bigint) temperature, {M6.format('min(l)')} log_loss from m group by 1")
def temperature_grid(t: Tables) -> DataFrame:
    """The best temperature of a fine grid by horizon: one aggregation over all rows and grid points."""
    y = F.when(F.col("result") == "home_win", 0).when(F.col("result") == "draw", 1).otherwise(2)
    losses = fit.temperature_losses(t.walk_forward_prediction.select("information_state", y.alias("y"), *PROBS.values()), ["information_state"], list(PROBS.values()), "y", [i / 100 for i in range(60, 161)])
    best = losses.groupBy("information_state").agg(F.min(F.struct("loss", "temperature")).alias("b"))
    return best.select("information_state", F.round(F.col("b.temperature") * 100).cast("long").alias("temperature"), F.floor(F.col("b.loss") * 1e6 + 0.5).cast("bigint").alias("log_loss"))


@query(f"with {_GRID}, r as (select *, row_number() over (partition by prediction_id order by {M6.format('p')} desc, h, a) rn from g) select prediction_id, h, a, {M6.format('p')} p from r where rn <= 3")
def likeliest_scores(t: Tables) -> DataFrame:
    """The three likeliest scores of every prediction."""
    cells = _cells(t).withColumn("m", micro("p"))
    return asof.latest_per_key(cells, ["prediction_id"], [F.desc("m"), F.col("h"), F.col("a")], 3).select("prediction_id", F.col("h").cast("long").alias("h"), F.col("a").cast("long").alias("a"), F.col("m").alias("p"))
