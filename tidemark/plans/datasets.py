"""Registered queries on datasets: agreed targets and conflicts, reasons, form as of a time, loaders, linking, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import asof, checks, context, linking, targets, upsert
from tidemark.plans.basics import scratch
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.relational import micro
from tidemark.sources import loaders, readers

R = Registry()
query = R.query
NAMESPACE = "6f1d4c1e-2f0a-5b7e-9c3d-8a4e5b6c7d80"
HOUR, DAY = 3_600_000_000, 86_400_000_000
CUTOVER = 1_704_067_200_000_000  # 2024-01-01
M6 = "cast(floor({0} * 1e6 + 0.5) as bigint)"

TARGETS = f"""tg as (select fixture_id, min(home_goals) h, min(away_goals) a, max(epoch_us(kickoff)) k, min(home_team_id) home, min(away_team_id) away,
      greatest(max(epoch_us(kickoff)) + {3 * HOUR}, case when max(epoch_us(kickoff)) >= {CUTOVER} then coalesce(max(epoch_us(source_max_retrieved_at)), 0) else 0 end) known_us
    from score_target where home_goals is not null and away_goals is not null group by 1 having count(distinct home_goals * 1000 + away_goals) = 1)"""


def _targets(t: Tables) -> DataFrame:
    s = t.score_target.select("fixture_id", "home_goals", "away_goals", F.unix_micros("kickoff").alias("k"), F.unix_micros("source_max_retrieved_at").alias("r"), "home_team_id", "away_team_id")
    agreed, _ = targets.agreed(s, ["fixture_id"], ["home_goals", "away_goals"], [F.max("k").alias("k"), F.max("r").alias("r"), F.min("home_team_id").alias("home"), F.min("away_team_id").alias("away")])
    return agreed.withColumn("known_us", targets.known_from(F.col("k"), F.col("r"), 3 * HOUR, CUTOVER))


@query(f"with {TARGETS} select fixture_id, h home_goals, a away_goals, case when h > a then 'home_win' when h = a then 'draw' else 'away_win' end as result, known_us from tg")
def regulation_targets(t: Tables) -> DataFrame:
    result = F.when(F.col("home_goals") > F.col("away_goals"), "home_win").when(F.col("home_goals") == F.col("away_goals"), "draw").otherwise("away_win")
    return _targets(t).select("fixture_id", "home_goals", "away_goals", result.alias("result"), "known_us")


@query("select fixture_id, count(distinct home_goals * 1000 + away_goals) scores, count(*) observations from score_target where home_goals is not null and away_goals is not null group by 1 having scores > 1")
def target_conflicts(t: Tables) -> DataFrame:
    _, conflicts = targets.agreed(t.score_target, ["fixture_id"], ["home_goals", "away_goals"], [])
    return conflicts


@query(f"select target_row_id, case when epoch_us(kickoff) >= {CUTOVER} then greatest(epoch_us(kickoff) + {3 * HOUR}, coalesce(epoch_us(source_max_retrieved_at), 0)) else epoch_us(kickoff) + {3 * HOUR} end known_us from score_target")
def forward_cutover(t: Tables) -> DataFrame:
    """Retrieval times only hold back what lies after the cut-over."""
    return t.score_target.select("target_row_id", targets.known_from(F.unix_micros("kickoff"), F.unix_micros("source_max_retrieved_at"), 3 * HOUR, CUTOVER).alias("known_us"))


@query("""select fixture_id, concat_ws(',', case when rule_code is null or rule_code = '' then 'no_rule' end, case when len(coalesce(observed_scores, [])) = 0 then 'no_scores' end, case when len(list_distinct(observed_scores)) < len(observed_scores) then 'repeated_scores' end,
    case when len(list_distinct(observed_scores)) < 2 then 'no_conflict' end) problems from target_exclusion""")
def exclusion_problems(t: Tables) -> DataFrame:
    s = F.col("observed_scores")
    found = F.concat_ws(",", F.when(F.col("rule_code").isNull() | (F.col("rule_code") == ""), "no_rule"), F.when(F.size(F.coalesce(s, F.array().cast(t.target_exclusion.schema["observed_scores"].dataType))) == 0, "no_scores"), F.when(F.size(F.array_distinct(s)) < F.size(s), "repeated_scores"), F.when(F.size(F.array_distinct(s)) < 2, "no_conflict"))
    return t.target_exclusion.select("fixture_id", found.alias("problems"))


@query("""with a as (select competition_id c, home_team_id h, away_team_id w, cast(epoch_us(kickoff) // 86400000000 as bigint) d, home_corners + away_corners = total_corners and home_corners - away_corners = corner_difference ok, home_corners x, away_corners y from corner_target where kickoff is not null)
    select c competition_id, h home_team_id, w away_team_id, d on_day, count(*) artifacts, count(*) filter (where ok) valid, count(distinct x * 1000 + y) filter (where ok) scores,
    case when count(*) filter (where ok) = 0 then 'no_valid_artifact' when count(distinct x * 1000 + y) filter (where ok) > 1 then 'conflict' else 'target' end outcome from a group by all""")
def corner_agreement(t: Tables) -> DataFrame:
    """First each artifact for itself, then those of a match together."""
    ok = (F.col("home_corners") + F.col("away_corners") == F.col("total_corners")) & (F.col("home_corners") - F.col("away_corners") == F.col("corner_difference"))
    rows = t.corner_target.where("kickoff is not null").withColumn("on_day", F.floor(F.unix_micros("kickoff") / DAY))
    return targets.agreement(rows, ["competition_id", "home_team_id", "away_team_id", "on_day"], ok, ["home_corners", "away_corners"])


@query("""with e as (select user_id, epoch_us(ts) // 86400000000 on_day, epoch_us(ts) // 60000000 m, event_id, event_type from events where event_type in ('purchase', 'signup')), f as (select user_id, on_day, min(m) m, count(*) n, count(*) filter (where event_type = 'purchase') home from e group by all)
    select f.user_id, f.on_day, f.n, case when count(distinct e.event_type) > 1 then 'tied' when min(e.event_type) = 'purchase' then 'home_first' else 'away_first' end outcome, min(e.event_id) event_id from f join e on e.user_id = f.user_id and e.on_day = f.on_day and e.m = f.m group by f.user_id, f.on_day, f.n""")
def first_scorers(t: Tables) -> DataFrame:
    """The earliest goal of every match; goals of both sides in one minute are a tie."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    goals = t.events.where("event_type in ('purchase', 'signup')").select("user_id", F.floor(us / DAY).alias("on_day"), F.floor(us / 60_000_000).alias("minute"), "event_id", (F.col("event_type") == "purchase").alias("is_home"))
    return targets.first_events(goals, ["user_id", "on_day"], "minute", "event_id", "is_home")


_REASONS = """r as (select performance_id, fixture_id, available_at, home_xg, row_number() over (partition by fixture_id, home_xg, away_xg, home_shots, away_shots, available_at order by performance_id) nth,
      count(home_xg) over (partition by fixture_id) > 1 and min(home_xg) over (partition by fixture_id) <> max(home_xg) over (partition by fixture_id) many from fixture_performance),
    s as (select performance_id, case when available_at is null then 'unknown_time' when home_xg is null then 'no_value' when nth > 1 then 'repeated' when many then 'versions_differ' else 'kept' end reason from r)"""


def _reasons(t: Tables) -> DataFrame:
    p, w = t.fixture_performance, W.partitionBy("fixture_id")
    same = W.partitionBy("fixture_id", "home_xg", "away_xg", "home_shots", "away_shots", "available_at").orderBy("performance_id")
    rows = p.withColumn("nth", F.row_number().over(same)).withColumn("many", F.coalesce(F.min("home_xg").over(w) != F.max("home_xg").over(w), F.lit(False)))
    reason = targets.first_reason({"unknown_time": F.col("available_at").isNull(), "no_value": F.col("home_xg").isNull(), "repeated": F.col("nth") > 1, "versions_differ": F.col("many")})
    return rows.select("performance_id", reason.alias("reason"))


@query(f"with {_REASONS} select performance_id, reason from s")
def exclusion_reasons(t: Tables) -> DataFrame:
    return _reasons(t)


@query(f"with {_REASONS} select reason, count(*) n from s group by 1")
def reason_funnel(t: Tables) -> DataFrame:
    return _reasons(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""with v as (select l_orderkey, count(distinct l_partkey) parts, count(distinct l_suppkey) suppliers, count(*) n, min(l_shipdate) first_ship from lineitem group by 1),
    o as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders join v on l_orderkey = o_orderkey where parts = n and suppliers >= 2 and n >= 3 and first_ship > o_orderdate)
    select o_custkey, o_orderkey from o where rn = 1""")
def first_valid_group(t: Tables) -> DataFrame:
    """The first order of a customer whose lines pass all checks of shape, as of line-ups."""
    shape = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"))
    valid = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(shape.where("parts = n and suppliers >= 2 and n >= 3"), "o_orderkey").where("first_ship > o_orderdate")
    return valid.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(f"""with f as (select internal_id, max(epoch_us(kickoff)) k from fixture_snapshot group by 1), h as (select internal_id, k, x.n lead_hours, k - x.n * {HOUR} cutoff from f, (values (24), (72)) x(n)),
    c as (select h.internal_id, h.lead_hours, h.k, s.kickoff, s.status, row_number() over (partition by h.internal_id, h.lead_hours order by epoch_us(s.loaded_at) desc nulls last, s.snapshot_no desc nulls last, epoch_us(s.kickoff) desc nulls last, s.status desc nulls last) rn, s.internal_id is null never
          from h left join fixture_snapshot s on s.internal_id = h.internal_id and epoch_us(s.loaded_at) <= h.cutoff)
    select internal_id, lead_hours, case when k is null then 'no_kickoff' when never then 'not_listed_yet' when kickoff is null then 'kickoff_unknown' when epoch_us(kickoff) <> k then 'kickoff_moved' else 'ready' end reason from c where rn = 1""")
def upcoming_with_reason(t: Tables) -> DataFrame:
    """Every fixture and horizon with what was known of it then, or why it can't be predicted."""
    s = t.fixture_snapshot.select("internal_id", "snapshot_no", F.unix_micros("loaded_at").alias("at"), F.unix_micros("kickoff").alias("told"), "status", F.lit(True).alias("listed"))
    probes = s.groupBy("internal_id").agg(F.max("told").alias("k")).withColumn("lead_hours", F.explode(F.array(F.lit(24), F.lit(72)))).withColumn("cutoff", F.col("k") - F.col("lead_hours").cast("bigint") * HOUR)
    known = asof.asof_join(probes, s.where("at is not null"), ["internal_id"], "cutoff", "at", ["listed", "told"], tie=["snapshot_no", "told", "status"])
    reason = targets.first_reason({"no_kickoff": F.col("k").isNull(), "not_listed_yet": F.col("listed").isNull(), "kickoff_unknown": F.col("told").isNull(), "kickoff_moved": F.col("told") != F.col("k")}, "ready")
    return known.select("internal_id", "lead_hours", reason.alias("reason"))


@query("""with q as (select fixture_id, selection, count(*) filter (where source = 'league_wire') a, count(*) filter (where source = 'goal_ledger') b, max(market_probability) filter (where source = 'league_wire') probability, max(market_decimal_multiplier) filter (where source = 'goal_ledger') multiplier from external_market_quote where fixture_id is not null group by all)
    select fixture_id, selection, probability, multiplier from q where a = 1 and b = 1""")
def two_source_pivot(t: Tables) -> DataFrame:
    """One value from one source, another from a second, where each has exactly one row."""
    of = lambda s, c: F.when(F.col("source") == s, F.col(c))
    per = t.external_market_quote.where("fixture_id is not null").groupBy("fixture_id", "selection").agg(F.count_if(F.col("source") == "league_wire").alias("a"), F.count_if(F.col("source") == "goal_ledger").alias("b"), F.max(of("league_wire", "market_probability")).alias("probability"), F.max(of("goal_ledger", "market_decimal_multiplier")).alias("multiplier"))
    return per.where("a = 1 and b = 1").drop("a", "b")


@query(f"""with {TARGETS}, tr as (select fixture_id, home team, k, known_us, h s, a c from tg union all select fixture_id, away, k, known_us, a, h from tg),
    r as (select p.fixture_id, p.team, b.s, b.c, row_number() over (partition by p.fixture_id, p.team order by b.known_us desc, b.k desc, b.fixture_id desc) rn from tr p join tr b on b.team = p.team and b.known_us < p.k)
    select fixture_id, team, count(*) played, cast(sum(case when s > c then 3 when s = c then 1 else 0 end) as bigint) points, cast(sum(s) as bigint) scored, cast(sum(c) as bigint) conceded, string_agg(case when s > c then 'W' when s = c then 'D' else 'L' end, '' order by rn) form from r where rn <= 5 group by all""")
def recent_form_as_of(t: Tables) -> DataFrame:
    """Of every match and side the five results that had become known last before its kick-off."""
    side = lambda team, s, c: F.struct(F.col(team).alias("team"), F.col(s).alias("scored"), F.col(c).alias("conceded"))
    rows = _targets(t).select("fixture_id", "k", "known_us", F.explode(F.array(side("home", "home_goals", "away_goals"), side("away", "away_goals", "home_goals"))).alias("x")).select("fixture_id", "k", "known_us", "x.*")
    return context.recent_form(rows, "team", "fixture_id", "k", "known_us", "scored", "conceded", 5)


@query(f"""with q as (select fixture_id, selection, observed_at, quote_id, market_probability p from external_market_quote where fixture_id is not null and observed_at is not null and market_probability between 0.02 and 0.98 and selection in ('home_win', 'draw', 'away_win')), c as (select fixture_id, max(prediction_at) cutoff from walk_forward_prediction group by 1),
    l as (select q.fixture_id, selection, p, row_number() over (partition by q.fixture_id, selection order by observed_at desc, quote_id) rn from q join c on c.fixture_id = q.fixture_id and q.observed_at < c.cutoff),
    w as (select fixture_id, max(case when selection = 'home_win' then p end) h, max(case when selection = 'draw' then p end) d, max(case when selection = 'away_win' then p end) a from l where rn = 1 group by 1)
    select fixture_id, {M6.format('h / (h + d + a)')} home_win, {M6.format('d / (h + d + a)')} draw, {M6.format('a / (h + d + a)')} away_win from w where h is not null and d is not null and a is not null""")
def latest_complete_quotes(t: Tables) -> DataFrame:
    """The latest usable quote of each selection before the cut-off, where all three are there, without the margin."""
    cutoffs = t.walk_forward_prediction.groupBy("fixture_id").agg(F.max("prediction_at").alias("cutoff"))
    usable = t.external_market_quote.where("fixture_id is not null and observed_at is not null and market_probability between 0.02 and 0.98").select("fixture_id", "selection", "observed_at", "quote_id", F.col("market_probability").alias("p"))
    return targets.complete_latest(usable.join(cutoffs, "fixture_id").where("observed_at < cutoff"), "fixture_id", "selection", ["home_win", "draw", "away_win"], "observed_at", "quote_id", "p").select("fixture_id", *[micro(c).alias(c) for c in ("home_win", "draw", "away_win")])


_NOW = "s as (select internal_id, kickoff, home_name, away_name, row_number() over (partition by internal_id order by snapshot_no desc, loaded_at desc, kickoff desc nulls last, home_name desc, away_name desc) rn from fixture_snapshot)"
_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _current(t: Tables) -> DataFrame:
    order = [F.desc("snapshot_no"), F.desc("loaded_at"), F.desc_nulls_last("kickoff"), F.desc("home_name"), F.desc("away_name")]
    return asof.latest_per_key(t.fixture_snapshot.select("internal_id", "snapshot_no", "loaded_at", "kickoff", "home_name", "away_name"), ["internal_id"], order)


@query(f"""with {_NOW}, c as (select corner_fixture_id, epoch_us(kickoff) k, {_N.format('home_name')} n from corner_target where kickoff is not null), f as (select internal_id, epoch_us(kickoff) k, {_N.format('home_name')} n from s where rn = 1 and kickoff is not null),
    p as (select corner_fixture_id, internal_id, abs(f.k - c.k) d from c join f on abs(f.k - c.k) <= {6 * HOUR} where c.n <> '' and f.n <> '' and (contains(' ' || c.n || ' ', ' ' || f.n || ' ') or contains(' ' || f.n || ' ', ' ' || c.n || ' '))),
    r as (select *, row_number() over (partition by corner_fixture_id order by d, internal_id) rn, lead(d) over (partition by corner_fixture_id order by d, internal_id) nxt from p)
    select corner_fixture_id, internal_id, d distance, coalesce(nxt - d < {HOUR // 2}, false) ambiguous from r where rn = 1""")
def event_links(t: Tables) -> DataFrame:
    """Events to fixtures: nearest in time within six hours among those whose name holds, or lies in, the event's."""
    left = t.corner_target.where("kickoff is not null").select("corner_fixture_id", F.unix_micros("kickoff").alias("k"), X.ascii_name(F.col("home_name")).alias("n"))
    right = _current(t).where("kickoff is not null").select("internal_id", F.unix_micros("kickoff").alias("k"), X.ascii_name(F.col("home_name")).alias("n"))
    return linking.nearest_by_name(left, right, "corner_fixture_id", "internal_id", "k", "n", 6 * HOUR, HOUR // 2)


@query("""with r as (select snapshot_no, internal_id, status, row_number() over (partition by snapshot_no, internal_id order by loaded_at desc, status desc nulls last) rn from fixture_snapshot), c as (select snapshot_no, internal_id, status from r where rn = 1), n as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) before from (select distinct snapshot_no from c)),
    b as (select n.snapshot_no, c.internal_id, c.status from n join c on c.snapshot_no = n.before), a as (select c.* from c join n using (snapshot_no) where before is not null)
    select coalesce(a.snapshot_no, b.snapshot_no) snapshot_no, coalesce(a.internal_id, b.internal_id) internal_id, case when b.internal_id is null then 'opened' when a.internal_id is null then 'resolved' else 'updated' end transition
    from a full join b on a.snapshot_no = b.snapshot_no and a.internal_id = b.internal_id where a.internal_id is null or b.internal_id is null or a.status is distinct from b.status""")
def expected_and_actual(t: Tables) -> DataFrame:
    """Each delivery compared in full with the one before: what is new, gone, or differs in status."""
    now = asof.latest_per_key(t.fixture_snapshot.select("snapshot_no", "internal_id", "status", "loaded_at"), ["snapshot_no", "internal_id"], [F.desc("loaded_at"), F.desc_nulls_last("status")]).drop("loaded_at")
    order = now.select("snapshot_no").distinct().withColumn("next", F.lead("snapshot_no").over(W.orderBy("snapshot_no")))  # one row a delivery
    before = now.join(order, "snapshot_no").where("next is not null").select(F.col("next").alias("snapshot_no"), "internal_id", "status")
    first = order.agg(F.min("snapshot_no").alias("first"))
    later = now.join(first, F.col("snapshot_no") > F.col("first")).drop("first")
    return checks.transitions(before, later, ["snapshot_no", "internal_id"], "status")


@query("""with o as (select fixture_id, information_state, min(prediction_id) prediction_id from walk_forward_prediction where evaluation_version = (select min(evaluation_version) from walk_forward_prediction) group by all),
    n as (select fixture_id, information_state, min(prediction_id) prediction_id from walk_forward_prediction group by all) select fixture_id, information_state, coalesce(o.prediction_id, n.prediction_id) prediction_id from n left join o using (fixture_id, information_state)""")
def insert_if_absent(t: Tables) -> DataFrame:
    """What was written first stays, rows of later evaluations only fill what is missing."""
    p, keys = t.walk_forward_prediction.select("fixture_id", "information_state", "prediction_id", "evaluation_version"), ["fixture_id", "information_state"]
    first = p.join(p.agg(F.min("evaluation_version").alias("evaluation_version")), "evaluation_version")
    order = [F.col("prediction_id")]
    written = asof.latest_per_key(first, keys, order).select(*keys, "prediction_id")
    return upsert.append_first(written, p.select(*keys, "prediction_id"), keys, order)


@query("""with k as (select lower(trim(home_name)) n, min(internal_id) id, count(distinct internal_id) c from fixture_record group by 1), mp as (select home_team_id, min(competition_id) id from score_target group by 1)
    select target_row_id, case when mp.id is not null and s.home_goals > 0 then 'mapped' when k.c = 1 then 'natural' else 'created' end as method, coalesce(case when s.home_goals > 0 then mp.id end, case when k.c = 1 then k.id end) entity
    from score_target s left join mp on mp.home_team_id = s.home_team_id and s.home_goals > 0 left join k on n = lower(trim(s.away_team_id))""")
def resolve_mapped(t: Tables) -> DataFrame:
    rows = t.score_target.select("target_row_id", F.when(F.col("home_goals") > 0, F.col("home_team_id")).alias("source_key"), F.lower(F.trim("away_team_id")).alias("n"))
    known = t.score_target.groupBy(F.col("home_team_id").alias("source_key")).agg(F.min("competition_id").alias("entity_id"))
    entities = t.fixture_record.select(F.lower(F.trim("home_name")).alias("n"), F.col("internal_id").alias("entity_id"))
    found = linking.resolve(rows, ["source_key"], ["n"], known, entities, X.stable_id("target", F.col("target_row_id"), namespace=NAMESPACE))
    return found.select("target_row_id", "method", F.when(F.col("method") != "created", F.col("entity_id")).alias("entity"))


@query(f"""with {_NOW}, c as (select corner_fixture_id l, {_N.format('home_name')} h, {_N.format('away_name')} a, epoch_us(kickoff) // {DAY} d from corner_target), f as (select internal_id r, {_N.format('home_name')} h, {_N.format('away_name')} a, epoch_us(kickoff) // {DAY} d from s where rn = 1),
    u as (select l, r, 1 tier from c join f using (h, a, d) union all select l, r, 2 from c join f using (h, d) union all select l, r, 3 from c join f using (a, d))
    select l, r, min(tier) tier from u group by all""")
def evidence_tiers(t: Tables) -> DataFrame:
    """Candidates from three tiers of evidence; of several the strongest counts."""
    names = lambda df, i, o: df.where("kickoff is not null").select(F.col(i).alias(o), X.ascii_name(F.col("home_name")).alias("h"), X.ascii_name(F.col("away_name")).alias("a"), F.floor(F.unix_micros("kickoff") / DAY).alias("d"))
    return linking.tiered(names(t.corner_target, "corner_fixture_id", "l"), names(_current(t), "internal_id", "r"), "l", "r", [["h", "a", "d"], ["h", "d"], ["a", "d"]])


@query("""with f as (select internal_id, lower(trim(home_name)) h, lower(trim(away_name)) a, competition_id c, min(kickoff) k from fixture_record group by all), p as (select * from f where k is null), q as (select h, a, c, min(internal_id) id, count(distinct internal_id) n from f where k is not null group by all)
    select p.internal_id, coalesce(max(case when q.n = 1 then q.id end), p.internal_id) linked_id from p left join q using (h, a, c) group by p.internal_id""")
def relinked_placeholders(t: Tables) -> DataFrame:
    """Fixtures that are only placeholders, linked to the one real fixture of the same sides, where there is one."""
    f = t.fixture_record.groupBy("internal_id", F.lower(F.trim("home_name")).alias("h"), F.lower(F.trim("away_name")).alias("a"), F.col("competition_id").alias("c")).agg(F.min("kickoff").alias("k"))
    return linking.relink(f, F.col("k").isNull(), "internal_id", ["h", "a", "c"])


_RULES = {"same_sides": "lower(trim(home_name)) = lower(trim(away_name))", "no_kickoff": "kickoff is null", "no_status": "status is null", "late_load": "loaded_at > snapshot_at + interval 2 hours"}


@query(f"""with h as ({' union all '.join(f"select distinct snapshot_no, internal_id, '{k}' rule from fixture_snapshot where {c}" for k, c in _RULES.items())}), n as (select snapshot_no, row_number() over (order by snapshot_no) i from (select distinct snapshot_no from fixture_snapshot)),
    o as (select rule, internal_id, i, lag(i) over (partition by rule, internal_id order by i) before, lead(i) over (partition by rule, internal_id order by i) after from h join n using (snapshot_no))
    select rule, internal_id, i delivery, case when before is null then 'opened' when before < i - 1 then 'reopened' end event from o where before is null or before < i - 1
    union all select rule, internal_id, i + 1, 'resolved' from o where (after is null or after > i + 1) and i < (select max(i) from n)""")
def issue_lifecycle(t: Tables) -> DataFrame:
    """Rules over every delivery: when an issue was opened, resolved and reopened."""
    rows = t.fixture_snapshot.select("snapshot_no", "internal_id", "home_name", "away_name", "kickoff", "status", "loaded_at", "snapshot_at")
    return checks.lifecycle(rows, "snapshot_no", "internal_id", {k: F.expr(c.replace("interval 2 hours", "interval '2' hour")) for k, c in _RULES.items()})


@query("select user_id, epoch_us(ts) // 86400000000 on_day, cast(json_extract_string(props, '$.k') as bigint) k, count(*) n from events group by all having count(*) > 1")
def repeated_json_entries(t: Tables) -> DataFrame:
    day = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 86400)
    return t.events.groupBy("user_id", day.alias("on_day"), F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""with l as (select l_orderkey, count(*) n, cast(floor(sum(l_extendedprice) * 100 + 0.5) as bigint) cents from lineitem group by 1), o as (select o_orderkey, cast(floor(o_totalprice * 100 + 0.5) as bigint) cents from orders)
    select coalesce(o.o_orderkey, l.l_orderkey) o_orderkey, case when l.l_orderkey is null then 'missing' when o.o_orderkey is null then 'unexpected' when abs(l.cents - o.cents) > 100 then 'value_differs' else 'agrees' end verdict, coalesce(l.n, 0) n from o full join l on l.l_orderkey = o.o_orderkey""")
def batch_reconciliation(t: Tables) -> DataFrame:
    """What a batch announced against what was loaded, by key, count and value."""
    cents = lambda c: F.floor(c * 100 + 0.5).cast("bigint")
    loaded = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), cents(F.sum("l_extendedprice")).alias("value"))
    return checks.reconciled(t.orders.select("o_orderkey", cents(F.col("o_totalprice")).alias("value")), loaded, ["o_orderkey"], "value", 100).select("o_orderkey", "verdict", F.coalesce("n", F.lit(0)).alias("n"))


@query("select sha256(concat_ws('|', fixture_id, model_key, information_state)) evidence_key, min(prediction_id) prediction_id from walk_forward_prediction group by 1")
def immutable_evidence(t: Tables) -> DataFrame:
    """Evidence under the hash of its business key; what was written first stays."""
    p = t.walk_forward_prediction.select(F.sha2(F.concat_ws("|", "fixture_id", "model_key", "information_state"), 256).alias("evidence_key"), "prediction_id")
    return p.groupBy("evidence_key").agg(F.min("prediction_id").alias("prediction_id"))


@query("""select target_row_id, right(season_id, 4) season, epoch_us(timezone('UTC', timezone('Europe/Berlin', date_trunc('minute', timezone('Europe/Berlin', kickoff))))) kickoff_us, unnest([home_team_id, away_team_id]) team, unnest([home_goals, away_goals]) goals, unnest([true, false]) is_home
    from score_target where season_id is not null and home_goals is not null and away_goals is not null and not (month(timezone('Europe/Berlin', kickoff)) = 10 and hour(timezone('Europe/Berlin', kickoff)) = 2)""")
def wide_match_csv(t: Tables) -> DataFrame:
    """A CSV file of matches as results services deliver it, local kick-offs and a column a side, to a row a side."""
    local = F.from_utc_timestamp("kickoff", "Europe/Berlin")
    wide = t.score_target.where("season_id is not null and home_goals is not null and away_goals is not null").where(~((F.month(local) == 10) & (F.hour(local) == 2)))
    wide.select("target_row_id", F.concat(F.lit("https://data.example/"), "season_id", F.lit(".csv")).alias("url"), F.date_format(local, "dd/MM/yyyy").alias("Date"), F.date_format(local, "HH:mm").alias("Time"), F.col("home_team_id").alias("HomeTeam"), F.col("away_team_id").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG")).write.option("header", True).csv(path := scratch(t, "wide"))
    return loaders.wide_matches(readers.read_csv(t.spark, path), ["target_row_id"], "Europe/Berlin").withColumn("target_row_id", F.col("target_row_id").cast("long"))


@query("select o_orderkey, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_quantity) - 1 ordinal, l_partkey part, l_quantity quantity from orders join lineitem on l_orderkey = o_orderkey")
def nested_children(t: Tables) -> DataFrame:
    """Matches nested with their child arrays, the match's id in a URL, to flat children with their place."""
    line = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    children = t.lineitem.groupBy("l_orderkey").agg(line.alias("lines"))
    docs = t.orders.join(children, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("https://data.example/matches/"), "o_orderkey", F.lit(".json")).alias("url"), F.to_json(F.struct("lines")).alias("body"))
    flat = loaders.nested_rows(docs, "url", r"/matches/(\d+)\.json$", "body", "lines", "array<struct<l_linenumber:bigint,l_partkey:bigint,l_quantity:double>>")
    return flat.select(F.col("record_id").cast("long").alias("o_orderkey"), "ordinal", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))


@query("select l_orderkey market, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_shipmode, cast(l_discount as varchar)) - 1 ordinal, l_shipmode outcome, l_discount price from (select l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus l_shipmode, l_discount from lineitem)")
def zipped_arrays(t: Tables) -> DataFrame:
    """Parallel arrays that came as JSON text, zipped by place."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("outcome"), F.col("l_discount").cast("string").alias("price")))).alias("x"))
    told = per.select(F.col("l_orderkey").alias("market"), F.to_json("x.outcome").alias("outcomes"), F.to_json("x.price").alias("prices"))
    return loaders.zipped(told, {"outcomes": "outcome", "prices": "price"}).select("market", "ordinal", "outcome", F.col("price").cast("double").alias("price"))


@query("select record_no, 'schedule' kind, kickoff as value from fixture_record where kickoff is not null union all select record_no, 'status', case when upper(trim(status)) = 'FT' then 'finished' when upper(trim(status)) = 'NS' then 'scheduled' else 'unknown' end from fixture_record where status is not null")
def fixture_observations(t: Tables) -> DataFrame:
    """A fixture's delivery as the observations it makes."""
    return loaders.observations(t.fixture_record, "record_no", {"schedule": F.col("kickoff"), "status": F.when(F.col("status").isNotNull(), F.coalesce(F.create_map(F.lit("FT"), F.lit("finished"), F.lit("NS"), F.lit("scheduled"))[F.upper(F.trim("status"))], F.lit("unknown")))})


@query("select l_orderkey, l_linenumber, cast(l_quantity as bigint) shots, case when l_discount > 0 then l_discount end possession from lineitem")
def typed_statistics(t: Tables) -> DataFrame:
    """Lists of type and value, as statistics come, to typed columns; what can't be read as its type is null."""
    each = F.array(F.struct(F.lit("shots").alias("type"), F.col("l_quantity").cast("int").cast("string").alias("value")), F.struct(F.lit("possession").alias("type"), F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("n/a").alias("value")), F.struct(F.lit("other").alias("type"), F.lit("1").alias("value")))
    told = t.lineitem.select("l_orderkey", "l_linenumber", F.to_json(each).alias("statistics"))
    return loaders.typed(told, "statistics", {"shots": "bigint", "possession": "double"}).drop("statistics")
