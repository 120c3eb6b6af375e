"""Registered queries on scalars, distributions, evaluation, state replay, linking, ledgers and streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.functions import text as X
from tidemark.operators import asof, context, fit, grid, ledger, linking, replay, stats
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.relational import mean_micro, micro
from tidemark.plans.views import TEAM_ROWS, TICKS, matches, team_rows, ticks
from tidemark.session import cut, own_folder
from tidemark.sources.readers import field_coverage as coverage
from tidemark.streaming import pipelines as stream

R = Registry()
query = R.query
NAMESPACE = "6f1d4c1e-2f0a-5b7e-9c3d-8a4e5b6c7d80"
CELLS = "cells as (select prediction_id, i.range h, j.range a, exp(-expected_home_goals + i.range * ln(expected_home_goals) - lgamma(i.range + 1) - expected_away_goals + j.range * ln(expected_away_goals) - lgamma(j.range + 1)) * {tau} p from walk_forward_prediction, range(13) i, range(13) j)"
TAU = "case when i.range = 0 and j.range = 0 then 1 - expected_home_goals * expected_away_goals * dixon_coles_rho when i.range = 0 and j.range = 1 then 1 + expected_home_goals * dixon_coles_rho when i.range = 1 and j.range = 0 then 1 + expected_away_goals * dixon_coles_rho when i.range = 1 and j.range = 1 then 1 - dixon_coles_rho else 1 end"
M6 = "cast(floor({0} * 1e6 + 0.5) as bigint)"


@query("select p_partkey, trim(regexp_replace(lower(replace(p_name, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) name from part")
def normalized_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.ascii_name(F.col("p_name")).alias("name"))


@query()
def club_names_folded(t: Tables) -> DataFrame:
    return t.fixture_record.select("record_no", X.transliterated_name("home_name").alias("home"), X.transliterated_name("away_name").alias("away"))


@query("select s_suppkey, nullif(regexp_extract(s_name, '^Supplier#0*([0-9]+)$', 1), '') number, regexp_matches(s_name, '^Supplier#[0-9]+$') well_formed from supplier")
def regex_parse(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.nullif(F.regexp_extract("s_name", r"^Supplier#0*([0-9]+)$", 1), F.lit("")).alias("number"), F.col("s_name").rlike(r"^Supplier#[0-9]+$").alias("well_formed"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) k from events")
def json_path_try_cast(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') month_key, strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m') next_month, date_diff('day', o_orderdate, date_trunc('month', o_orderdate) + interval 1 month) - 1 + 10 days_to_mature from orders")
def month_maturity(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month_key"), F.date_format(F.add_months(F.trunc(d, "month"), 1), "yyyy-MM").alias("next_month"), (F.date_diff(F.last_day(d), d) + 10).cast("bigint").alias("days_to_mature"))


@query(f"with {TICKS} select user_id, sec // 21600 slot, min(event_id) event_id, count(*) n from tk group by all")
def slot_floor_dedupe(t: Tables) -> DataFrame:
    return ticks(t).groupBy("user_id", F.floor(F.col("sec") / 21600).alias("slot")).agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n"))


@query("with b as (select min(o_orderdate)::date lo, max(o_orderdate)::date hi from orders), s as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) d from b), c as (select o_orderdate::date d, count(*) n from orders group by 1) select cast(s.d as varchar) on_day, coalesce(n, 0) n from s left join c using (d)")
def date_spine_gaps(t: Tables) -> DataFrame:
    d = t.orders.select(F.to_date("o_orderdate").alias("d"))
    spine = d.agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d"))
    return spine.join(d.groupBy("d").agg(F.count(F.lit(1)).alias("n")), "d", "left").select(F.col("d").cast("string").alias("on_day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select c_custkey, sha256(concat_ws('|', 'customer', c_custkey, c_mktsegment)) sha from customer")
def content_sha(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2(F.concat_ws("|", F.lit("customer"), F.col("c_custkey").cast("string"), "c_mktsegment"), 256).alias("sha"))


@query(f"""with s as (select c_custkey, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('customer|' || c_custkey || '|' || c_mktsegment)) h from customer)
    select c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', position(substr(h, 17, 1) in '0123456789abcdef'), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) id from s""")
def stable_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.stable_id("customer", F.col("c_custkey"), F.col("c_mktsegment"), namespace=NAMESPACE).alias("id"))


def _grid(t: Tables, rho) -> DataFrame:
    return grid.score_rows(t.walk_forward_prediction, ["prediction_id"], F.col("expected_home_goals"), F.col("expected_away_goals"), rho)


def _outcomes(cells: DataFrame) -> DataFrame:
    return grid.outcome_probabilities(cells, ["prediction_id"]).select("prediction_id", *[micro(k).alias(k) for k in ("home_win", "draw", "away_win")])


_MONEY = "with {cells}, s as (select prediction_id, sum(p) z, sum(p) filter (where h > a) w, sum(p) filter (where h = a) d, sum(p) filter (where h < a) l from cells group by 1) select prediction_id, " + ", ".join(M6.format(f"{c} / z") + f" {n}" for c, n in (("w", "home_win"), ("d", "draw"), ("l", "away_win"))) + " from s"


@query(_MONEY.format(cells=CELLS.format(tau="1")))
def poisson_moneyline(t: Tables) -> DataFrame:
    return _outcomes(_grid(t, F.lit(0.0)))


@query(_MONEY.format(cells=CELLS.format(tau=TAU)))
def dixon_coles_moneyline(t: Tables) -> DataFrame:
    return _outcomes(_grid(t, F.col("dixon_coles_rho")))


@query(f"with {CELLS.format(tau=TAU)}, z as (select prediction_id, sum(p) z from cells group by 1) select prediction_id, h home, a away, {M6.format('p / z')} p from cells join z using (prediction_id)")
def score_grid_cells(t: Tables) -> DataFrame:
    return _grid(t, F.col("dixon_coles_rho")).select("prediction_id", F.col("h").cast("bigint").alias("home"), F.col("a").cast("bigint").alias("away"), micro("p").alias("p"))


@query(f"""with {CELLS.format(tau='1')}, tot as (select prediction_id, h + a k, sum(p) p from cells group by all), cdf as (select prediction_id, k, sum(p) over (partition by prediction_id order by k) / sum(p) over (partition by prediction_id) f from tot)
    select prediction_id, {M6.format('sum(pow(f - case when home_goals + away_goals <= k then 1 else 0 end, 2))')} rps from cdf join walk_forward_prediction using (prediction_id) group by prediction_id""")
def grid_marginals_rps(t: Tables) -> DataFrame:
    cells = grid.score_rows(t.walk_forward_prediction.withColumn("y", F.col("home_goals") + F.col("away_goals")), ["prediction_id", "y"], F.col("expected_home_goals"), F.col("expected_away_goals"), F.lit(0.0))
    totals = cells.groupBy("prediction_id", "y", (F.col("h") + F.col("a")).alias("k")).agg(F.sum("p").alias("p"))
    cdf = totals.withColumn("f", F.sum("p").over(W.partitionBy("prediction_id").orderBy("k")))
    d = F.col("f") - F.when(F.col("y") <= F.col("k"), 1.0).otherwise(0.0)
    return cdf.groupBy("prediction_id").agg(F.sum(d * d).alias("s")).select("prediction_id", micro("s").alias("rps"))


PROBS = {"home_win": "home_win_probability", "draw": "draw_probability", "away_win": "away_win_probability"}


@query(f"with s as (select prediction_id, case result when 'home_win' then home_win_probability when 'draw' then draw_probability else away_win_probability end p, pow(home_win_probability - (result = 'home_win')::int, 2) + pow(draw_probability - (result = 'draw')::int, 2) + pow(away_win_probability - (result = 'away_win')::int, 2) b, (pow(home_win_probability - (result = 'home_win')::int, 2) + pow(home_win_probability + draw_probability - (result <> 'away_win')::int, 2)) / 2 r from walk_forward_prediction) select prediction_id, {M6.format('-ln(greatest(p, 1e-15))')} log_loss, {M6.format('b')} brier, {M6.format('r')} rps from s")
def proper_scores(t: Tables) -> DataFrame:
    p = t.walk_forward_prediction.select("prediction_id", "result", *PROBS.values())
    hit = F.coalesce(*[F.when(F.col("result") == k, F.col(c)) for k, c in PROBS.items()])
    rank = F.when(F.col("result") == "home_win", 0).when(F.col("result") == "draw", 1).otherwise(2)
    scored = p.select("prediction_id", P.log_loss(hit).alias("l"), P.brier({k: F.col(c) for k, c in PROBS.items()}, F.col("result")).alias("b"), P.ranked_probability_score([F.col("home_win_probability"), F.col("home_win_probability") + F.col("draw_probability")], rank).alias("r"))
    return scored.select("prediction_id", micro("l").alias("log_loss"), micro("b").alias("brier"), micro("r").alias("rps"))


@query(f"with e as (select prediction_id, exp(ln(home_win_probability) / 1.17) h, exp(ln(draw_probability) / 1.17) d, exp(ln(away_win_probability) / 1.17) a from walk_forward_prediction) select prediction_id, {M6.format('h / (h + d + a)')} home_win, {M6.format('d / (h + d + a)')} draw, {M6.format('a / (h + d + a)')} away_win from e")
def temperature_scale(t: Tables) -> DataFrame:
    scaled = P.tempered([F.col(c) for c in PROBS.values()], F.lit(1.17))
    df = t.walk_forward_prediction.select("prediction_id", *[s.alias(k) for k, s in zip(PROBS, scaled, strict=True)])
    return df.select("prediction_id", *[micro(k).alias(k) for k in PROBS])


@query()
def temperature_fit(t: Tables) -> DataFrame:
    p = t.walk_forward_prediction.select("information_state", *PROBS.values(), F.when(F.col("result") == "home_win", 0).when(F.col("result") == "draw", 1).otherwise(2).alias("y"))
    rows = [(s, fit.fit_temperature(p.where(F.col("information_state") == s), list(PROBS.values()), "y")) for s in ("T-24h", "T-72h")]
    return t.spark.createDataFrame(rows, "information_state string, temperature double")


@query()
def rich_rate_newton(t: Tables) -> DataFrame:
    p = t.walk_forward_prediction.select("fixture_id", "information_state", "home_goals", "expected_home_goals")
    f = t.rich_rate_feature.groupBy("fixture_id", "information_state").agg(F.avg("home_xg_attack").alias("x"), F.avg("home_shots_attack").alias("s"))
    joined = p.join(f, ["fixture_id", "information_state"]).where("x is not null and s is not null").persist()
    beta = fit.fit_poisson(joined, "home_goals", F.ln("expected_home_goals"), [F.ln(F.col("x") / 1.25), F.ln(F.col("s") / 12.0)])
    joined.unpersist()
    return t.spark.createDataFrame([("xg", beta[0]), ("shots", beta[1])], "feature string, coefficient double")


@query(f"with c as (select model_key, information_state, fold_key, moneyline_log_loss l, moneyline_brier b, exact_score_log_loss e from walk_forward_prediction) select model_key, information_state, fold_key, count(*) n, {M6.format('avg(l)')} log_loss, {M6.format('avg(b)')} brier, {M6.format('avg(e)')} exact from c group by all")
def metric_summary(t: Tables) -> DataFrame:
    return t.walk_forward_prediction.groupBy("model_key", "information_state", "fold_key").agg(F.count(F.lit(1)).alias("n"), mean_micro("moneyline_log_loss").alias("log_loss"), mean_micro("moneyline_brier").alias("brier"), mean_micro("exact_score_log_loss").alias("exact"))


def _pooled(t: Tables) -> DataFrame:
    """A row for each class of each prediction: ``model_key, p, hit``."""
    each = F.array(*[F.struct(F.col(c).alias("p"), (F.col("result") == k).alias("hit")) for k, c in PROBS.items()])
    return t.walk_forward_prediction.select("model_key", F.explode(each).alias("x")).select("model_key", "x.p", "x.hit")


POOLED = "pool as (" + " union all ".join(f"select model_key, {c} p, (result = '{k}')::int hit from walk_forward_prediction" for k, c in PROBS.items()) + ")"


@query(f"with {POOLED}, b as (select model_key, least(floor(p * 10), 9) bin, count(*) n, avg(p) p, avg(hit) y from pool group by all) select model_key, {M6.format('sum(n * abs(p - y)) / sum(n)')} ece, cast(sum(n) as bigint) n from b group by 1")
def ece_uniform_bins(t: Tables) -> DataFrame:
    return stats.expected_calibration_error(_pooled(t), ["model_key"], "p", "hit").select("model_key", micro("ece").alias("ece"), "n")


@query(f"with {POOLED} select case when p < 0.1 then 0 when p < 0.25 then 1 when p < 0.5 then 2 else 3 end bin, count(*) n, {M6.format('avg(p)')} mean_probability, {M6.format('avg(hit)')} hit_rate from pool where p >= 0 and p <= 1 group by 1")
def calibration_edges(t: Tables) -> DataFrame:
    return stats.calibration_table(_pooled(t), "p", "hit", [0.0, 0.1, 0.25, 0.5, 1.0]).select("bin", "n", micro("mean_probability").alias("mean_probability"), micro("hit_rate").alias("hit_rate"))


@query()
def month_block_bootstrap(t: Tables) -> DataFrame:
    return stats.block_bootstrap(t.walk_forward_prediction.withColumn("d", F.col("moneyline_log_loss") - F.lit(1.0)), "fold_key", "d", 500, 20260714)


@query(f"""with {TEAM_ROWS} select a.fixture_id, a.team, {M6.format("coalesce(sum(pow(2, -(a.kick - b.kick) / 259200.0)), 0)")} evidence_weight, {M6.format("(5 * 1.25 + coalesce(sum(b.scored * pow(2, -(a.kick - b.kick) / 259200.0)), 0)) / (5 + coalesce(sum(pow(2, -(a.kick - b.kick) / 259200.0)), 0))")} evidence_mean
    from tr a left join tr b on b.team = a.team and b.kick < a.kick group by a.fixture_id, a.team, a.kick""")
def decayed_evidence(t: Tables) -> DataFrame:
    rows = team_rows(t).select("fixture_id", "team", "kick", "scored")
    out = replay.decayed_evidence(rows, ["team"], "kick", "scored", 259200.0, 1.25, 5.0, 525600.0)
    return out.select("fixture_id", "team", micro("evidence_weight").alias("evidence_weight"), micro("evidence_mean").alias("evidence_mean"))


@query(f"select prediction_id, {M6.format('(125 + coalesce(sum(home_goals) over w, 0)) / (125 + coalesce(sum(expected_home_goals) over w, 0))')} scale from (select *, epoch_us(kickoff) k from walk_forward_prediction) window w as (partition by model_key, information_state, fold_key order by k range between unbounded preceding and 1 preceding)")
def prequential_scales(t: Tables) -> DataFrame:
    p = t.walk_forward_prediction.withColumn("k", F.unix_micros("kickoff"))
    return p.withColumn("s", replay.running_scale(p, ["model_key", "information_state", "fold_key"], "k", "home_goals", "expected_home_goals", 125.0, 125.0)).select("prediction_id", micro("s").alias("scale"))


@query()
def state_replay_goals(t: Tables) -> DataFrame:
    return replay.state_replay(replay.coupled(cut(matches(t).withColumn("neutral", F.lit(False)))), F.col("group"), replay.ReplaySpec())


@query()
def state_replay_corners(t: Tables) -> DataFrame:
    spec = replay.ReplaySpec(level=1.6094379, level_sd=0.2, level_half_life=365.0, home=0.08, home_sd=0.15, low=0.2, high=20.0, defence_sign=1)
    return replay.state_replay(replay.coupled(cut(matches(t).withColumn("neutral", F.col("fixture_id") % 10 == 0))), F.col("group"), spec)


@query()
def stream_state_replay(t: Tables) -> DataFrame:
    """The replay over a stream of events in four deliveries, with the states kept between them."""
    spec, at = replay.ReplaySpec(), f"{own_folder(t.spark)}/replay/{uuid.uuid4().hex}"
    played = cut(matches(t).withColumn("neutral", F.lit(False)))
    events = cut(replay.replay_events(replay.coupled(played), F.col("group"), spec))
    edges = events.agg(F.percentile_approx("_t", [0.25, 0.5, 0.75], 1000)).first()[0] or [0, 0, 0]
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = events.where(F.lit(True) if low is None else F.col("_t") > low).where(F.lit(True) if high is None else F.col("_t") <= high)
        part.coalesce(1).write.parquet(f"{at}/events/part={i}")
    source = stream.parquet_stream(t.spark, f"{at}/events/*", events.schema)
    return stream.run_to_table(stream.replayed(source, spec), f"{at}/out")


@query(f"with {CELLS.format(tau='1')}, g as (select prediction_id, h, a, p, h > a r, h = a d, p * exp(0.1 * h - 0.05 * a) q from cells), s as (select *, q / sum(q) over (partition by prediction_id, r, d) * sum(p) over (partition by prediction_id, r, d) / sum(p) over (partition by prediction_id) x from g) select prediction_id, {M6.format('sum(h * x)')} home_mean, {M6.format('sum(x) filter (where r)')} home_win from s group by 1")
def conditional_tilt(t: Tables) -> DataFrame:
    """Home goals tilted within each outcome, whose probability stays."""
    cells = _grid(t, F.lit(0.0)).withColumn("r", F.col("h") > F.col("a")).withColumn("d", F.col("h") == F.col("a"))
    features = {"home": F.col("h").cast("double"), "away": F.col("a").cast("double")}
    sums = grid.tilted_sums(cells, ["prediction_id"], features, {"home": 0.1, "away": -0.05}, {"m": F.col("h"), "w": F.when(F.col("r"), 1.0)}, ["r", "d"])
    return sums.select("prediction_id", micro("m").alias("home_mean"), micro("w").alias("home_win"))


@query(f"select corner_fixture_id, {M6.format('exp(lgamma(total_corners + 8.0) - lgamma(8.0) - lgamma(total_corners + 1) + 8.0 * ln(8.0 / 18.2) + total_corners * ln(10.2 / 18.2))')} p from corner_target")
def corner_pmf(t: Tables) -> DataFrame:
    return t.corner_target.select("corner_fixture_id", P.negative_binomial(F.col("total_corners"), F.lit(10.2), F.lit(8.0)).alias("p")).select("corner_fixture_id", micro("p").alias("p"))


@query(f"with s as (select l_suppkey, avg(l_discount) d, count(*) n from lineitem group by 1), g as (select avg(l_discount) m from lineitem) select l_suppkey, n, {M6.format('(900 * m + n * d) / (900 + n)')} shrunk from s, g")
def player_shrinkage(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    whole = t.lineitem.agg(F.avg("l_discount").alias("m"))  # one row
    return per.crossJoin(F.broadcast(whole)).withColumn("s", (900 * F.col("m") + F.col("n") * F.col("d")) / (900 + F.col("n"))).select("l_suppkey", "n", micro("s").alias("shrunk"))


@query(f"with {TEAM_ROWS}, r as (select *, row_number() over (partition by team order by kick desc, fixture_id desc) rn from tr) select team, {M6.format('avg(scored)')} typical from r where rn <= 20 group by 1")
def typical_last_n(t: Tables) -> DataFrame:
    last = asof.latest_per_key(team_rows(t), ["team"], [F.desc("kick"), F.desc("fixture_id")], 20)
    return last.groupBy("team").agg(mean_micro("scored").alias("typical"))


@query(f"select l_orderkey, l_linenumber, l_partkey, {M6.format('l_quantity / sum(l_quantity) over (partition by l_orderkey)')} share from lineitem")
def normalized_shares(t: Tables) -> DataFrame:
    share = F.col("l_quantity") / F.sum("l_quantity").over(W.partitionBy("l_orderkey"))
    return t.lineitem.withColumn("s", share).select("l_orderkey", "l_linenumber", "l_partkey", micro("s").alias("share"))


@query(f"""with {TEAM_ROWS} select fixture_id, team, cast(coalesce(sum(scored) over w, 0) as bigint) before_scored, count(*) over w before_played from tr window w as (partition by team order by kick range between unbounded preceding and 1 preceding)""")
def running_player_diag(t: Tables) -> DataFrame:
    rows = team_rows(t).select("fixture_id", "team", "kick", "scored")
    return context.running_before(rows, ["team"], "kick", {"before_scored": F.col("scored"), "before_played": F.lit(1).cast("long")}, 525_600).select("fixture_id", "team", "before_scored", "before_played")


@query("""with f as (select fixture_id, min(fold_key) mo from walk_forward_prediction group by 1), c as (select mo, count(*) n from f group by 1), r as (select mo, sum(n) over (order by mo) total from c) select min(mo) cutoff, cast(min(total) as bigint) fixtures from r where total >= 300""")
def readiness_counts(t: Tables) -> DataFrame:
    first = t.walk_forward_prediction.groupBy("fixture_id").agg(F.min("fold_key").alias("mo"))
    per = first.groupBy("mo").agg(F.count(F.lit(1)).alias("n"))  # one row a month
    return per.withColumn("total", F.sum("n").over(W.orderBy("mo"))).where("total >= 300").agg(F.min("mo").alias("cutoff"), F.min("total").alias("fixtures"))


@query("""select a.record_no, b.record_no other, case when a.home_name = b.home_name then 100 else 0 end + case when a.away_name = b.away_name then 70 else 0 end + case when a.status = b.status then 30 else 0 end score
    from fixture_record a join fixture_record b on a.internal_id = b.internal_id and a.record_no < b.record_no where a.competition_id = b.competition_id""")
def candidate_scoring(t: Tables) -> DataFrame:
    f = t.fixture_record.select("record_no", "internal_id", "home_name", "away_name", "status", "competition_id")
    g = f.toDF("other", "internal_id", *[f"o_{c}" for c in ("home_name", "away_name", "status", "competition_id")])
    same = lambda c: F.col(c) == F.col(f"o_{c}")
    score = linking.link_score([(same("home_name"), 100), (same("away_name"), 70), (same("status"), 30)], ~same("competition_id"))
    return f.join(g, "internal_id").where("record_no < other").withColumn("score", score.cast("int")).where("score is not null").select("record_no", "other", "score")


@query()
def mutual_best_match(t: Tables) -> DataFrame:
    """Corner rows and fixtures of a day, as last delivered, that are each other's best by their names. Pairs meet by a
    word of four letters or more that both home or both away names have."""
    words = lambda c: F.filter(F.split(X.ascii_name(F.col(c)), " "), lambda w: F.length(w) >= 4)
    keys = F.explode(F.array_distinct(F.concat(F.transform(words("home_name"), lambda w: F.concat(F.lit("h"), w)), F.transform(words("away_name"), lambda w: F.concat(F.lit("a"), w)))))
    side = lambda df, i, o: df.where("kickoff is not null").select(F.col(i).alias(o), F.to_date("kickoff").alias("d"), F.col("home_name").alias(f"{o}h"), F.col("away_name").alias(f"{o}a"), keys.alias("word"))
    order = [F.desc("snapshot_no"), F.desc("loaded_at"), F.desc_nulls_last("kickoff"), F.desc("home_name"), F.desc("away_name")]
    pairs = side(t.corner_target, "corner_fixture_id", "l").join(side(asof.latest_per_key(t.fixture_snapshot, ["internal_id"], order), "internal_id", "r"), ["d", "word"]).drop("word").distinct()
    near = lambda a, b: 100 - 10 * F.least(F.levenshtein(a, b), F.lit(10))
    return linking.mutual_best(pairs.withColumn("score", (near("lh", "rh") + near("la", "ra")).cast("int")), ["d"], "l", "r", "score", 120, 25).select("l", "r", "score")


_RECORD = """sha256('{"before_sha256":"' || %s || '","fold_key":"' || p.fold_key || '","loss":' || p.loss || ',"n":' || p.n || '}')"""


@query(f"""with recursive p as (select fold_key, count(*) n, {M6.format('avg(moneyline_log_loss)')} loss, row_number() over (order by fold_key) i from walk_forward_prediction group by 1),
    c as (select i, fold_key, n, loss, repeat('0', 64) before_sha256, {_RECORD % "repeat('0', 64)"} own_sha256 from p where i = 1 union all select p.i, p.fold_key, p.n, p.loss, c.own_sha256, {_RECORD % 'c.own_sha256'} from c join p on p.i = c.i + 1) select fold_key, n, loss, before_sha256, own_sha256 from c""")
def ledger_hash_chain(t: Tables) -> DataFrame:
    """The chain over monthly summaries; the summaries are aggregated on the cluster, the chain is one row a month."""
    per = t.walk_forward_prediction.groupBy("fold_key").agg(F.count(F.lit(1)).alias("n"), mean_micro("moneyline_log_loss").alias("loss")).orderBy("fold_key")
    rows = ledger.append([r.asDict() for r in per.collect()])
    schema = "fold_key string, n long, loss long, before_sha256 string, own_sha256 string"
    chain = t.spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    return chain.join(ledger.broken_links(chain, "fold_key").select("fold_key"), "fold_key", "left_anti")


@query("""with h as (select sha256(to_json({'away_goals': away_goals, 'fixture_id': fixture_id, 'home_goals': home_goals, 'target_row_id': target_row_id})::varchar) h from score_target), c as (select count(*) n, sum(('0x' || substr(h, 1, 15))::bigint) a, sum(('0x' || substr(h, 16, 15))::bigint) b, sum(('0x' || substr(h, 31, 15))::bigint) d from h)
    select n "rows", sha256(concat_ws('|', n, a, b, d)) digest from c""")
def table_digests(t: Tables) -> DataFrame:
    return ledger.table_digest(t.score_target.select("target_row_id", "fixture_id", "home_goals", "away_goals"), ["target_row_id", "fixture_id", "home_goals", "away_goals"])


@query("""with p as (select payload from raw_match_payload where json_valid(payload)) select path, present, filled from (""" + " union all ".join(f"select '{x}' path, count(*) filter (where json_exists(payload, '$.{x}')) present, count(*) filter (where json_exists(payload, '$.{x}') and json_type(payload, '$.{x}') <> 'NULL') filled from p" for x in ("fixture.id", "lineups", "players", "statistics", "score.fulltime.home")) + ")")
def field_coverage(t: Tables) -> DataFrame:
    return coverage(t.raw_match_payload, "payload", ["fixture.id", "lineups", "players", "statistics", "score.fulltime.home"])


def _stream(t: Tables, name: str) -> DataFrame:
    path = f"{t.sf_dir}/{name}.parquet"
    schema = t.spark.read.parquet(path).schema
    return stream.parquet_stream(t.spark, path if os.path.isdir(path) else f"{t.sf_dir}/{name}*.parquet", schema)


def _run(df: DataFrame, mode: str) -> DataFrame:
    return stream.run_to_table(df, f"{own_folder(df.sparkSession)}/streams/{uuid.uuid4().hex}", mode)


@query("select event_id from events")
def stream_dedupe_watermark(t: Tables) -> DataFrame:
    e = _stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _run(stream.unique_within(e, ["event_id"], "at", "30 days"), "append").select("event_id")


@query("select epoch_us(ts) // 21600000000 slot, event_type, count(*) n from events group by all")
def stream_tumbling_windows(t: Tables) -> DataFrame:
    e = _stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _run(stream.tumbling(e, "at", "6 hours", ["event_type"], "value", "1 day"), "complete").select(F.floor(F.unix_seconds("window_start") / 21600).alias("slot"), "event_type", "n")


@query("select user_id as \"key\", count(*) n from events group by 1")
def stream_keyed_state(t: Tables) -> DataFrame:
    e = _stream(t, "events").withColumn("at", F.col("ts").cast("timestamp"))
    updates = _run(stream.running_state(e, "user_id", "at", "value"), "update")
    return updates.groupBy("key").agg(F.max("n").alias("n"))


@query("select count(*) filter (where r < k and r >= k - 259200) in_window, count(*) filter (where not (r < k and r >= k - 259200)) outside from (select epoch(prediction_at) r, epoch(kickoff) k from walk_forward_prediction)")
def late_side_output(t: Tables) -> DataFrame:
    ok, late = stream.split_late("prediction_at", "kickoff", "3 days")(t.walk_forward_prediction)
    both = ok.select(F.lit(True).alias("ok")).unionAll(late.select(F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("in_window"), F.count_if(~F.col("ok")).alias("outside"))
