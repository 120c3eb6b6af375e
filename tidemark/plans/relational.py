"""Registered queries on joins, aggregates, windows, sorts and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof, checks, context, stats, upsert
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.views import MATCHES, TEAM_ROWS, TICKS, matches, team_rows, ticks

R = Registry()
query = R.query
result = lambda a, b: F.when(F.col(a) > F.col(b), "home_win").when(F.col(a) == F.col(b), "draw").otherwise("away_win")
mean_micro = lambda c: F.floor(F.avg(c) * 1e6 + 0.5).cast("bigint")
micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("bigint")


@query(f"with {MATCHES} select fixture_id, competition, home, away, home_goals, away_goals, case when home_goals > away_goals then 'home_win' when home_goals = away_goals then 'draw' else 'away_win' end result, home_goals + away_goals total_goals, home_goals - away_goals goal_difference, home_goals > 0 and away_goals > 0 both_scored from m")
def match_targets(t: Tables) -> DataFrame:
    return matches(t).select("fixture_id", "competition", "home", "away", "home_goals", "away_goals", result("home_goals", "away_goals").alias("result"), (F.col("home_goals") + F.col("away_goals")).alias("total_goals"), (F.col("home_goals") - F.col("away_goals")).alias("goal_difference"), ((F.col("home_goals") > 0) & (F.col("away_goals") > 0)).alias("both_scored"))


@query(f"with {TEAM_ROWS}, r as (select *, row_number() over (partition by team order by kick desc, fixture_id desc) rn from tr) select team, count(*) played, cast(sum(case when scored > conceded then 3 when scored = conceded then 1 else 0 end) as bigint) points, cast(sum(scored) as bigint) scored, cast(sum(conceded) as bigint) conceded from r where rn <= 5 group by team")
def team_form_last5(t: Tables) -> DataFrame:
    last = asof.latest_per_key(team_rows(t), ["team"], [F.desc("kick"), F.desc("fixture_id")], 5)
    points = F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
    return last.groupBy("team").agg(F.count(F.lit(1)).alias("played"), F.sum(points).alias("points"), F.sum("scored").alias("scored"), F.sum("conceded").alias("conceded"))


@query("""with p as (select fixture_id, home_goals h, away_goals a, count(*) n from score_target where home_goals is not null and away_goals is not null group by all)
    select fixture_id, count(*) n_scores, cast(sum(n) as bigint) n_rows from p group by 1 having count(*) > 1""")
def conflicting_observations(t: Tables) -> DataFrame:
    pairs = t.score_target.where("home_goals is not null and away_goals is not null").groupBy("fixture_id", "home_goals", "away_goals").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n_scores"), F.sum("n").alias("n_rows")).where("n_scores > 1")


@query(f"""with {TEAM_ROWS} select fixture_id, team, coalesce(kick - max(kick) over (partition by team order by kick range between unbounded preceding and 1 preceding), -1) rest_minutes,
    count(*) over (partition by team order by kick range between 10080 preceding and 1 preceding) last7, count(*) over (partition by team order by kick range between 43200 preceding and 1 preceding) last30 from tr""")
def rest_congestion(t: Tables) -> DataFrame:
    recent = context.looking_back(team_rows(t).select("fixture_id", "team", "kick"), ["team"], "kick", {"last7": (F.count(F.lit(1)), 10080), "last30": (F.count(F.lit(1)), 43200)})
    return context.last_before(recent, ["team"], "kick", 43200).select("fixture_id", "team", F.coalesce(F.col("kick") - F.col("last"), F.lit(-1)).alias("rest_minutes"), "last7", "last30")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1")
def latest_status_per_key(t: Tables) -> DataFrame:
    return asof.latest_per_key(ticks(t), ["user_id", "event_type"], [F.desc("sec"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


_ASOF = """with {T}, p as (select user_id, sec, event_id from tk where event_type = 'purchase'), v as (select user_id, sec, event_id view_id, row_number() over (partition by user_id, sec order by event_id desc) rn from tk where event_type = 'view')
    select p.event_id, coalesce(v.view_id, -1) view_id from p asof left join (select * from v where rn = 1) v on v.user_id = p.user_id and v.sec {op} p.sec"""


def _views_before(t: Tables, inclusive: bool, lookback: int | None = None) -> DataFrame:
    e = ticks(t)
    builds = e.where("event_type = 'view'").select("user_id", "sec", F.col("event_id").alias("view_id"))
    return asof.asof_join(e.where("event_type = 'purchase'").select("user_id", "sec", "event_id"), builds, ["user_id"], "sec", "sec", ["view_id"], inclusive=inclusive, tie=["view_id"], lookback=lookback).select("event_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query(_ASOF.format(T=TICKS, op="<="))
def asof_latest_inclusive(t: Tables) -> DataFrame:
    return _views_before(t, True)


@query(f"""with {TICKS}, p as (select * from tk where event_type = 'purchase'), c as (select p.event_id, v.event_id view_id, row_number() over (partition by p.event_id order by v.sec desc nulls last, v.event_id desc) rn from p left join tk v on v.event_type = 'view' and v.user_id = p.user_id and v.sec < p.sec and v.sec >= p.sec - 86400)
    select event_id, coalesce(view_id, -1) view_id from c where rn = 1""")
def asof_strict_window(t: Tables) -> DataFrame:
    return _views_before(t, False, 86400)


@query(f"""with {TICKS} select p.event_id, (select arg_max(v.value, v.sec * 1000000 + v.event_id) from tk v where v.user_id = p.user_id and v.event_type = 'click' and v.sec <= p.sec) last_click_value from tk p where p.event_type = 'error'""")
def asof_scalar_argmax(t: Tables) -> DataFrame:
    e = ticks(t)
    builds = e.where("event_type = 'click' and value is not null").select("user_id", "sec", "event_id", F.col("value").alias("last_click_value"))
    return asof.asof_join(e.where("event_type = 'error'").select("user_id", "sec", F.col("event_id").alias("probe")), builds, ["user_id"], "sec", "sec", ["last_click_value"], tie=["event_id"]).select(F.col("probe").alias("event_id"), "last_click_value")


@query(f"""with {TEAM_ROWS} select a.fixture_id, a.team from tr a where not exists (select 1 from tr b where b.team = a.team and b.fixture_id <> a.fixture_id and b.kick >= a.kick - 4320 and b.kick < a.kick)""")
def clean_horizon_filter(t: Tables) -> DataFrame:
    return context.looking_back(team_rows(t).select("fixture_id", "team", "kick"), ["team"], "kick", {"n": (F.count(F.lit(1)), 4320)}).where("n = 0").select("fixture_id", "team")


@query(f"""with {TICKS}, c as (select l.event_id, r.event_id other, abs(r.sec - l.sec) d, row_number() over (partition by l.event_id order by abs(r.sec - l.sec), r.event_id) rn from tk l join tk r on r.user_id = l.user_id and r.event_type = 'click' and abs(r.sec - l.sec) <= 21600 where l.event_type = 'purchase')
    select a.event_id, a.other click_id, a.d distance, coalesce(b.d - a.d < 1800, false) ambiguous from c a left join c b on b.event_id = a.event_id and b.rn = 2 where a.rn = 1""")
def nearest_match_ambiguity(t: Tables) -> DataFrame:
    e = ticks(t)
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "sec")
    return asof.nearest_with_margin(e.where("event_type = 'purchase'").select("user_id", "event_id", "sec"), right, ["user_id"], "event_id", "sec", "click_id", "sec", 21600, 1800)


@query(f"with {TEAM_ROWS} select a.fixture_id, a.team, count(*) recent, cast(sum(b.scored) as bigint) scored from tr a join tr b on b.team = a.team and b.kick < a.kick and b.kick >= a.kick - 14400 group by all")
def band_lookback_join(t: Tables) -> DataFrame:
    """A band join of which only sums are asked needs no pairs: windows over spans of time give them."""
    rows = team_rows(t).select("fixture_id", "team", "kick", F.col("scored").alias("s"))
    return context.looking_back(rows, ["team"], "kick", {"recent": (F.count(F.lit(1)), 14400), "scored": (F.sum("s"), 14400)}).where("recent > 0").select("fixture_id", "team", "recent", "scored")


@query(f"with {MATCHES} select fixture_id, h.n_name home_name, a.n_name away_name, r_name competition_name from m join nation h on h.n_nationkey = home join nation a on a.n_nationkey = away join region on r_regionkey = competition")
def role_playing_dims(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return matches(t).join(n.toDF("home", "home_name"), "home").join(n.toDF("away", "away_name"), "away").join(t.region.select(F.col("r_regionkey").alias("competition"), F.col("r_name").alias("competition_name")), "competition").select("fixture_id", "home_name", "away_name", "competition_name")


@query("select c_custkey, count(o_orderkey) orders, coalesce(sum(o_totalprice), 0) total from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by c_custkey")
def left_default_coalesce(t: Tables) -> DataFrame:
    per = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total"))
    return t.customer.select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 40)")
def semi_exists(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_not_exists(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("with l as (select distinct l_orderkey from lineitem where l_tax > 0.07) select o_custkey, count(*) orders, count(*) filter (where o_orderkey in (select l_orderkey from l)) taxed from orders group by o_custkey")
def exists_in_filter_agg(t: Tables) -> DataFrame:
    taxed = t.lineitem.where("l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("taxed")).distinct()
    return t.orders.join(taxed, "o_orderkey", "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.coalesce("taxed", F.lit(False))).alias("taxed"))


@query("select a.l_orderkey, count(*) // 2 pairs from lineitem a join lineitem b on b.l_orderkey = a.l_orderkey and b.l_returnflag <> a.l_returnflag group by a.l_orderkey")
def residual_inequality_join(t: Tables) -> DataFrame:
    # all pairs of lines of an order differ in flag, unless both have one: counted from the counts by flag
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return per.select("l_orderkey", ((F.col("s") * F.col("s") - F.col("q")) / 2).cast("bigint").alias("pairs")).where("pairs > 0")


@query("""select 'negative_balance' rule, 'warning' severity, 'customer' entity_type, cast(c_custkey as varchar) entity_id from customer where c_acctbal < 0
    union all select 'order_without_lines', 'error', 'order', cast(o_orderkey as varchar) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
    union all select 'incomplete_target', 'error', 'target', cast(target_row_id as varchar) from score_target where home_goals is null or away_goals is null
    union all select 'same_team', 'error', 'target', cast(target_row_id as varchar) from score_target where home_team_id = away_team_id
    union all select 'duplicate_record', 'warning', 'fixture', internal_id from fixture_record group by internal_id having count(*) > 1""")
def quality_rules_union(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.issues({
        "negative_balance": ("warning", "customer", t.customer.where("c_acctbal < 0").select("c_custkey")),
        "order_without_lines": ("error", "order", t.orders.select("o_orderkey").join(lines, "o_orderkey", "left_anti")),
        "incomplete_target": ("error", "target", t.score_target.where("home_goals is null or away_goals is null").select("target_row_id")),
        "same_team": ("error", "target", t.score_target.where("home_team_id = away_team_id").select("target_row_id")),
        "duplicate_record": ("warning", "fixture", t.fixture_record.groupBy("internal_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("internal_id")),
    })


@query("""select o_orderkey, bool_and(l_quantity >= 5) all_large, bool_or(l_returnflag = 'R') any_returned, count(distinct l_suppkey) suppliers,
    concat_ws(',', case when bool_or(l_returnflag = 'R') then 'returned' end, case when count(*) = 1 then 'single_line' end, case when max(l_discount) > 0.09 then 'discounted' end) reasons
    from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def flags_with_reasons(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_quantity") >= 5).alias("all_large"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("d"))
    reasons = F.concat_ws(",", F.when(F.col("any_returned"), "returned"), F.when(F.col("n") == 1, "single_line"), F.when(F.col("d") > 0.09, "discounted"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey").select("o_orderkey", "all_large", "any_returned", "suppliers", reasons.alias("reasons"))


@query("""with f as (select internal_id id from fixture_record group by 1) select id internal_id, (select count(*) from score_target s where s.fixture_id = id) targets, (select count(*) from fixture_performance p where p.fixture_id = id) performances, (select count(*) from external_market_quote q where q.fixture_id = id) quotes from f""")
def completeness_index(t: Tables) -> DataFrame:
    n = lambda df, name: df.groupBy(F.col("fixture_id").alias("internal_id")).agg(F.count(F.lit(1)).alias(name))
    out = t.fixture_record.select("internal_id").distinct()
    for df, name in ((t.score_target, "targets"), (t.fixture_performance, "performances"), (t.external_market_quote, "quotes")):
        out = out.join(n(df.select("fixture_id"), name), "internal_id", "left").fillna({name: 0})
    return out


@query("select fixture_id, max(case when selection = 'home_win' then market_probability end) home, max(case when selection = 'draw' then market_probability end) draw, max(case when selection = 'away_win' then market_probability end) away, count(*) filter (where market_probability is null) missing from external_market_quote where fixture_id is not null group by 1")
def pivot_max_case(t: Tables) -> DataFrame:
    pick = lambda s, name: F.max(F.when(F.col("selection") == s, F.col("market_probability"))).alias(name)
    return t.external_market_quote.where("fixture_id is not null").groupBy("fixture_id").agg(pick("home_win", "home"), pick("draw", "draw"), pick("away_win", "away"), F.count_if(F.col("market_probability").isNull()).alias("missing"))


@query("select l_suppkey, count(*) filter (where l_returnflag = 'R') returned, count(distinct l_partkey) filter (where l_discount > 0.05) discounted_parts, max(l_quantity) filter (where l_linestatus = 'O') largest_open from lineitem group by 1")
def conditional_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted_parts"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("largest_open"))


@query("select l_orderkey, array_to_string(list(l_partkey order by l_partkey), ',') parts, array_to_string(list(l_linenumber || ':' || l_suppkey order by l_linenumber, l_suppkey), ',') lines from lineitem group by 1")
def ordered_list_agg(t: Tables) -> DataFrame:
    parts = F.array_join(F.array_sort(F.collect_list("l_partkey")), ",")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_suppkey"])), ",")
    return t.lineitem.groupBy("l_orderkey").agg(parts.alias("parts"), lines.alias("lines"))


@query("select o_orderpriority, o_orderstatus, count(*) n, max(o_totalprice) top from orders group by all")
def group_by_all(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("select o_custkey, count(*) n from orders group by 1 having count(*) >= 12")
def having_threshold(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")


@query("""select performance_id, count(*) over (partition by fixture_id) deliveries, (select count(distinct (home_xg, away_xg, home_shots, away_shots)) from fixture_performance b where b.fixture_id = a.fixture_id) versions from fixture_performance a""")
def dup_versions_window(t: Tables) -> DataFrame:
    p = t.fixture_performance.select("performance_id", "fixture_id", F.struct("home_xg", "away_xg", "home_shots", "away_shots").alias("v"))
    per = p.groupBy("fixture_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("v").alias("versions"))
    return p.select("performance_id", "fixture_id").join(per, "fixture_id").select("performance_id", "deliveries", "versions")


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 occurrence from events")
def occurrence_index(t: Tables) -> DataFrame:
    return ticks(t).select("event_id", (F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("sec", "event_id")) - 1).cast("bigint").alias("occurrence"))


@query("select o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 5 + 1 batch from orders")
def batch_numbering(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.floor((F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 5) + 1).alias("batch"))


@query("with s as (select o_custkey, o_orderkey, o_totalprice p, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn, lead(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey) nx from orders) select o_custkey, o_orderkey, cast(floor((p - coalesce(nx, 0)) * 100 + 0.5) as bigint) margin_cents from s where rn = 1")
def best_margin(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    two = asof.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return two.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("o_totalprice").over(w)).where("rn = 1").select("o_custkey", "o_orderkey", F.floor((F.col("o_totalprice") - F.coalesce("nx", F.lit(0.0))) * 100 + 0.5).cast("bigint").alias("margin_cents"))


@query("with c as (select user_id, event_type, count(*) n from events where event_type is not null group by all), r as (select *, row_number() over (partition by user_id order by n desc, event_type) rn from c) select user_id, event_type, n from r where rn = 1")
def modal_value_tiebreak(t: Tables) -> DataFrame:
    return stats.modal_value(t.events, ["user_id"], "event_type")


@query("select l_returnflag, count(l_quantity) n, cast(floor(avg(l_quantity) * 1e6 + 0.5) as bigint) mean, quantile_cont(l_quantity, 0.5) median, quantile_cont(l_quantity, 0.9) p90, quantile_cont(l_quantity, 0.95) p95, max(l_quantity) max from lineitem group by 1")
def exact_quantiles(t: Tables) -> DataFrame:
    return stats.distribution_summary(t.lineitem, ["l_returnflag"], "l_quantity").withColumn("mean", micro("mean"))


@query("select p_brand, cast(floor(sum(p_size * p_retailprice) / sum(p_size) * 1e6 + 0.5) as bigint) weighted_mean, cast(floor(sum(p_size)::double * sum(p_size) / sum(p_size * p_size) * 1e6 + 0.5) as bigint) effective_n from part group by 1")
def weighted_mean_ess(t: Tables) -> DataFrame:
    df = stats.weighted_mean(t.part.withColumn("w", F.col("p_size").cast("double")), ["p_brand"], "p_retailprice", "w")
    return df.select("p_brand", micro("weighted_mean").alias("weighted_mean"), micro("effective_n").alias("effective_n"))


@query("with r as (select information_state, avg((fixture_id in (select fixture_id from external_market_quote where fixture_id is not null))::int) coverage from walk_forward_prediction group by 1) select prediction_id, cast(floor(least(1 / coverage, 4.0) * 1e6 + 0.5) as bigint) weight from walk_forward_prediction join r using (information_state) where fixture_id in (select fixture_id from external_market_quote where fixture_id is not null) and coverage >= 0.1")
def selection_bias_weights(t: Tables) -> DataFrame:
    quoted = t.external_market_quote.select("fixture_id").where("fixture_id is not null").distinct().withColumn("covered", F.lit(True))
    p = t.walk_forward_prediction.select("prediction_id", "fixture_id", "information_state").join(quoted, "fixture_id", "left").fillna({"covered": False})
    return stats.inverse_coverage_weights(p, ["information_state"], "covered", 0.1, 4.0).where("weight is not null").select("prediction_id", micro("weight").alias("weight"))


@query("select threshold, cast(floor(avg((value > threshold)::int) * 1e6 + 0.5) as bigint) share from events, (values (10.0::double), (50.0), (90.0)) v(threshold) where value is not null group by 1")
def exceedance_freq(t: Tables) -> DataFrame:
    return stats.exceedance(t.events.where("value is not null"), "value", [10.0, 50.0, 90.0]).select("threshold", micro("share").alias("share"))


@query("select case when p_size <= 10 then 0 when p_size <= 20 then 1 when p_size <= 40 then 2 else 3 end bin, count(*) n from part group by 1")
def histogram_bins(t: Tables) -> DataFrame:
    return t.part.select(stats.upper_bound_bin(F.col("p_size"), [10, 20, 40]).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("select o_custkey, o_orderkey, rk from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rk from orders) where rk <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rk")).where("rk <= 3")


@query("select l_suppkey, l_partkey, l_orderkey from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber) rn from lineitem) where rn = 1")
def argmax_tiebreak(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_partkey", "l_linenumber")).alias("b"))
    return best.select("l_suppkey", "b.l_partkey", "b.l_orderkey")


@query("with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i, count(*) over () n from orders), k as (select distinct cast(round_even(x.i * (n - 1) / 24.0, 0) as bigint) place from (select max(n) n from r), range(25) x(i)) select o_orderkey from r join k on place = r.i")
def even_sample(t: Tables) -> DataFrame:
    return stats.evenly_spaced(t.orders.select("o_orderkey"), ["o_orderkey"], 25)


@query("select prediction_id, case when fold_key < '2022-07' then 'development' when fold_key < '2023-07' then 'calibration' else 'test' end fold from walk_forward_prediction")
def fold_assignment(t: Tables) -> DataFrame:
    return t.walk_forward_prediction.select("prediction_id", F.when(F.col("fold_key") < "2022-07", "development").when(F.col("fold_key") < "2023-07", "calibration").otherwise("test").alias("fold"))


@query("""with n as (select fixture_id, home_xg, home_shots, row_number() over (partition by fixture_id order by available_at desc nulls last, performance_id desc) rn from fixture_performance) select fixture_id, home_xg, home_shots from n where rn = 1""")
def upsert_replace(t: Tables) -> DataFrame:
    return upsert.last_write(t.fixture_performance, ["fixture_id"], [F.col("available_at").desc_nulls_last(), F.desc("performance_id")]).select("fixture_id", "home_xg", "home_shots")


@query("""with o as (select fixture_id, min(performance_id) id, count(*) attempts from fixture_performance where performance_id % 2 = 0 group by 1), n as (select fixture_id, max(performance_id) id, count(*) attempts from fixture_performance where performance_id % 2 = 1 group by 1),
    a as (select o.fixture_id, p.home_xg, p.home_shots, attempts from o join fixture_performance p on p.performance_id = o.id), b as (select n.fixture_id, p.home_xg, p.home_shots, attempts from n join fixture_performance p on p.performance_id = n.id)
    select coalesce(a.fixture_id, b.fixture_id) fixture_id, coalesce(b.home_xg, a.home_xg) home_xg, coalesce(a.home_shots, b.home_shots) home_shots, coalesce(a.attempts + b.attempts, a.attempts, b.attempts) attempts from a full join b on a.fixture_id = b.fixture_id""")
def upsert_coalesce(t: Tables) -> DataFrame:
    # odd and even ids stand for two loads; both parts together are the whole table
    def load(rest: int, pick: str) -> DataFrame:
        p = t.fixture_performance.where(F.col("performance_id") % 2 == rest)
        best = F.min if pick == "first" else F.max
        return p.groupBy("fixture_id").agg(best(F.struct("performance_id", "home_xg", "home_shots")).alias("r"), F.count(F.lit(1)).alias("attempts")).select("fixture_id", "r.home_xg", "r.home_shots", "attempts")

    return upsert.upsert(load(0, "first"), load(1, "last"), ["fixture_id"], {"home_xg": "coalesce_new", "home_shots": "coalesce_old", "attempts": "increment"})


@query("with k as (select s_nationkey, min(s_suppkey) new_id from supplier group by 1), mp as (select s_suppkey old_id, new_id from supplier join k using (s_nationkey)) select new_id l_suppkey, count(*) n from lineitem join mp on old_id = l_suppkey group by 1")
def rekey_merge(t: Tables) -> DataFrame:
    _, mapping = upsert.merge_entities(t.supplier, "s_suppkey", ["s_nationkey"], ["s_name"])
    return upsert.rekey(t.lineitem.select("l_suppkey"), mapping, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("select o_custkey, o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) is not null seen, cast(floor(coalesce(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) * 100 + 0.5) as bigint) before_cents from orders")
def running_before(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    s = F.sum("o_totalprice").over(w)
    return t.orders.select("o_custkey", "o_orderkey", s.isNotNull().alias("seen"), F.floor(F.coalesce(s, F.lit(0.0)) * 100 + 0.5).cast("bigint").alias("before_cents"))


@query("select n_name from nation union select r_name from region")
def set_union(t: Tables) -> DataFrame:
    return t.nation.select("n_name").union(t.region.select("r_name")).distinct()


@query("select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_discount = 0")
def set_algebra(t: Tables) -> DataFrame:
    parts = lambda c: t.lineitem.where(c).select("l_partkey")
    return parts("l_returnflag = 'R'").intersect(parts("l_returnflag = 'A'")).subtract(parts("l_discount = 0"))


@query("select 'h' side, o_orderkey, o_totalprice v from orders union all select 'd', o_orderkey, cast(epoch_us(o_orderdate) // 86400000000 as double) from orders")
def unpivot_wide_to_long(t: Tables) -> DataFrame:
    days = F.expr("cast(timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz)) as double)")
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("h"), days.alias("d")).unpivot(["o_orderkey"], ["h", "d"], "side", "v").select("side", "o_orderkey", "v")


@query("select count(*) n, count(distinct prediction_id) n_ids, min(epoch_us(kickoff)) first_us, max(epoch_us(kickoff)) last_us from walk_forward_prediction")
def verify_artifact(t: Tables) -> DataFrame:
    return t.walk_forward_prediction.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prediction_id").alias("n_ids"), F.unix_micros(F.min("kickoff")).alias("first_us"), F.unix_micros(F.max("kickoff")).alias("last_us"))


@query("""with p as (select fixture_id, information_state, prediction_id, row_number() over (partition by fixture_id, information_state, model_key order by prediction_id desc) rn, model_key, moneyline_log_loss l from walk_forward_prediction),
    d as (select fixture_id, information_state, max(case when model_key = 'dixon_style' then l end) - max(case when model_key = 'score_rate' then l end) delta from p where rn = 1 group by all)
    select information_state, count(delta) n, cast(floor(avg(delta) * 1e6 + 0.5) as bigint) mean_delta from d group by 1""")
def paired_model_delta(t: Tables) -> DataFrame:
    p = asof.latest_per_key(t.walk_forward_prediction.select("fixture_id", "information_state", "model_key", "prediction_id", "moneyline_log_loss"), ["fixture_id", "information_state", "model_key"], [F.desc("prediction_id")])
    pick = lambda k: F.max(F.when(F.col("model_key") == k, F.col("moneyline_log_loss")))
    d = p.groupBy("fixture_id", "information_state").agg((pick("dixon_style") - pick("score_rate")).alias("delta"))
    return d.groupBy("information_state").agg(F.count("delta").alias("n"), mean_micro("delta").alias("mean_delta"))


@query("""with o as (select *, 3 - (o_orderkey % 3) prio from orders) select o_custkey, arg_min(o_orderkey, prio * 1000000000000 + o_orderkey) o_orderkey from o group by 1""")
def priority_dedupe(t: Tables) -> DataFrame:
    return asof.latest_per_key(t.orders.withColumn("prio", 3 - F.col("o_orderkey") % 3), ["o_custkey"], [F.col("prio"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")
