"""Further registered queries: predicates, nullable keys, updates, horizons, distributions and grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import probability as P
from tidemark.functions import text as X
from tidemark.operators import asof, ledger, upsert
from tidemark.plans.registry import Registry, Tables
from tidemark.plans.relational import micro
from tidemark.plans.views import MATCHES, matches

R = Registry()
query = R.query
M6 = "cast(floor({0} * 1e6 + 0.5) as bigint)"


@query("select performance_id from fixture_performance where (home_xg is null or home_xg between 0 and 3) and (away_shots is null or home_shots is null or away_shots <= home_shots) and home_xg is distinct from away_xg")
def guarded_predicates(t: Tables) -> DataFrame:
    p = t.fixture_performance
    ok = (F.col("home_xg").isNull() | F.col("home_xg").between(0, 3)) & (F.col("away_shots").isNull() | F.col("home_shots").isNull() | (F.col("away_shots") <= F.col("home_shots")))
    return p.where(ok & ~F.col("home_xg").eqNullSafe(F.col("away_xg"))).select("performance_id")


@query("select a.target_row_id, count(b.target_row_id) same from score_target a join score_target b on b.fixture_id = a.fixture_id and coalesce(b.season_id, '') = coalesce(a.season_id, '') group by 1")
def nullable_key_join(t: Tables) -> DataFrame:
    k = t.score_target.select("target_row_id", "fixture_id", F.coalesce("season_id", F.lit("")).alias("season"))
    per = k.groupBy("fixture_id", "season").agg(F.count(F.lit(1)).alias("same"))
    return k.join(per, ["fixture_id", "season"]).select("target_row_id", "same")


@query("with k as (select home_name, away_name, competition_id, min(internal_id) id, count(distinct internal_id) n from fixture_record group by 1, 2, 3) select corner_fixture_id, id internal_id from corner_target join k using (home_name, away_name, competition_id) where n = 1")
def exactly_one_match(t: Tables) -> DataFrame:
    key = ["home_name", "away_name", "competition_id"]
    one = t.fixture_record.groupBy(*key).agg(F.min("internal_id").alias("internal_id"), F.count_distinct("internal_id").alias("n")).where("n = 1")
    return t.corner_target.join(one, key).select("corner_fixture_id", "internal_id")


@query("select o_orderkey, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'O' and l_quantity > 30) then 'X' else o_orderstatus end status from orders")
def conditional_update(t: Tables) -> DataFrame:
    hit = t.lineitem.where("l_linestatus = 'O' and l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t.orders.join(hit, "o_orderkey", "left").select("o_orderkey", F.when(F.col("hit"), "X").otherwise(F.col("o_orderstatus")).alias("status"))


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_discount > 0.08)")
def delete_by_semi_join(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(gone, "p_partkey", "left_anti")


@query("select s_suppkey from supplier order by s_acctbal desc nulls last, s_suppkey limit 25")
def top_report(t: Tables) -> DataFrame:
    return t.supplier.orderBy(F.col("s_acctbal").desc_nulls_last(), "s_suppkey").limit(25).select("s_suppkey")


@query("""with f as (select internal_id, max(kickoff) k from fixture_snapshot where kickoff is not null group by 1), h as (select internal_id, k, x.n from f, (values (24), (72)) x(n)),
    c as (select h.internal_id, h.n, s.snapshot_no, row_number() over (partition by h.internal_id, h.n order by s.loaded_at desc, s.snapshot_no desc) rn from h join fixture_snapshot s on s.internal_id = h.internal_id and s.loaded_at <= h.k - to_hours(h.n))
    select internal_id, n lead_hours, snapshot_no from c where rn = 1""")
def schedule_known_at_horizon(t: Tables) -> DataFrame:
    s = t.fixture_snapshot.select("internal_id", "snapshot_no", F.unix_micros("loaded_at").alias("at"), F.unix_micros("kickoff").alias("k"))
    probes = s.where("k is not null").groupBy("internal_id").agg(F.max("k").alias("k")).select("internal_id", "k", F.explode(F.array(F.lit(24), F.lit(72))).alias("lead_hours")).withColumn("cutoff", F.col("k") - F.col("lead_hours").cast("bigint") * 3_600_000_000)
    known = asof.asof_join(probes.drop("k"), s.where("at is not null").select("internal_id", "at", "snapshot_no"), ["internal_id"], "cutoff", "at", ["snapshot_no"], tie=["snapshot_no"])
    return known.where("snapshot_no is not null").select("internal_id", "lead_hours", "snapshot_no")


@query(f"select prediction_id, {M6.format('(1 - exp(-(expected_home_goals + expected_away_goals))) * expected_home_goals / (expected_home_goals + expected_away_goals)')} home_first, {M6.format('exp(-(expected_home_goals + expected_away_goals))')} no_goal from walk_forward_prediction")
def first_score_baseline(t: Tables) -> DataFrame:
    h, a = F.col("expected_home_goals"), F.col("expected_away_goals")
    p = t.walk_forward_prediction.select("prediction_id", ((1 - F.exp(-(h + a))) * h / (h + a)).alias("f"), F.exp(-(h + a)).alias("n"))
    return p.select("prediction_id", micro("f").alias("home_first"), micro("n").alias("no_goal"))


@query(f"""select corner_fixture_id, {M6.format("exp(-(5.5 + 4.5 + 0.4)) * (select sum(exp((home_corners - i.range) * ln(5.5) - lgamma(home_corners - i.range + 1) + (away_corners - i.range) * ln(4.5) - lgamma(away_corners - i.range + 1) + i.range * ln(0.4) - lgamma(i.range + 1))) from range(60) i where i.range <= least(home_corners, away_corners))")} p from corner_target""")
def bivariate_pmf(t: Tables) -> DataFrame:
    p = P.bivariate_poisson_pmf(F.col("home_corners"), F.col("away_corners"), F.lit(5.5), F.lit(4.5), F.lit(0.4))
    return t.corner_target.select("corner_fixture_id", p.alias("p")).select("corner_fixture_id", micro("p").alias("p"))


@query(f"select home_corners k, {M6.format('exp(-5.3 + home_corners * ln(5.3) - lgamma(home_corners + 1))')} p, count(*) n from corner_target group by home_corners")
def poisson_pmf_table(t: Tables) -> DataFrame:
    per = t.corner_target.groupBy(F.col("home_corners").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("p", P.poisson_pmf(F.col("k"), F.lit(5.3))).select("k", micro("p").alias("p"), "n")


@query("select n_name, o_orderstatus, count(*) n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by rollup (n_name, o_orderstatus)")
def rollup_extra(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.rollup("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("select prediction_id from (select prediction_id, count(*) over (partition by fixture_id, model_key, information_state) n, row_number() over (partition by fixture_id, model_key, information_state order by prediction_id) rn, max(home_win_probability) over w - min(home_win_probability) over w d from walk_forward_prediction window w as (partition by fixture_id, model_key, information_state)) where rn = 1 and n > 1 and d <= 0.1")
def agreeing_repeats(t: Tables) -> DataFrame:
    key = ["fixture_id", "model_key", "information_state"]
    per = t.walk_forward_prediction.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("prediction_id").alias("prediction_id"), (F.max("home_win_probability") - F.min("home_win_probability")).alias("d"))
    return per.where("n > 1 and d <= 0.1").select("prediction_id")


@query("select internal_id, list_aggregate(list_sort(list_distinct(list(lower(trim(home_name))))), 'string_agg', '|') names from fixture_record group by 1")
def alias_sets(t: Tables) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("home_name")))), "|")
    return t.fixture_record.groupBy("internal_id").agg(names.alias("names"))


@query(f"with {MATCHES} select competition, count(*) n, count(distinct home) clubs, min(kick) first, max(kick) last from m where kick >= 14000000 and kick < 14500000 group by 1")
def bounded_range_summary(t: Tables) -> DataFrame:
    return matches(t).where("kick >= 14000000 and kick < 14500000").groupBy("competition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("home").alias("clubs"), F.min("kick").alias("first"), F.max("kick").alias("last"))


@query("select quote_id, regexp_replace(lower(consensus_method), '[^a-z]+', '_', 'g') method from external_market_quote where consensus_method is not null")
def method_spellings(t: Tables) -> DataFrame:
    return t.external_market_quote.where("consensus_method is not null").select("quote_id", F.regexp_replace(F.lower("consensus_method"), "[^a-z]+", "_").alias("method"))


@query("with u as (select home_team_id team, kickoff k, fixture_id f, target_row_id i from score_target union all select away_team_id, kickoff, fixture_id, target_row_id from score_target), d as (select distinct team, f, epoch_us(k) k from u) select team, f, coalesce(k - lag(k) over (partition by team order by k, f), -1) gap from d")
def gaps_between_matches(t: Tables) -> DataFrame:
    rows = t.score_target.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team"), F.col("fixture_id").alias("f"), F.unix_micros("kickoff").alias("k")).distinct()
    w = W.partitionBy("team").orderBy("k", "f")
    return rows.select("team", "f", F.coalesce(F.col("k") - F.lag("k").over(w), F.lit(-1)).alias("gap"))


@query("select corner_fixture_id, ' ' || trim(regexp_replace(lower(home_name), '[^a-z0-9]+', ' ', 'g')) || ' ' like '% u21 %' second_side from corner_target")
def whole_word_containment(t: Tables) -> DataFrame:
    return t.corner_target.select("corner_fixture_id", X.contains_words(X.ascii_name(F.col("home_name")), F.lit("u21")).alias("second_side"))


@query("select target_row_id, sha256(to_json({'away_goals': away_goals, 'fixture_id': fixture_id, 'home_goals': home_goals, 'season_id': season_id, 'target_row_id': target_row_id})::varchar) sha256 from score_target")
def row_hashes(t: Tables) -> DataFrame:
    cols = ["target_row_id", "fixture_id", "home_goals", "away_goals", "season_id"]
    return t.score_target.select("target_row_id", ledger.row_hash(cols).alias("sha256"))


@query("""with n as (select distinct internal_id, trim(regexp_replace(lower(strip_accents(replace(home_name, '&', ' and '))), '[^a-z0-9]+', ' ', 'g')) n from fixture_record), p as (select a.internal_id, a.n, b.n o, string_split(a.n, ' ') x, string_split(b.n, ' ') y from n a join n b on b.internal_id = a.internal_id and a.n < b.n)
    select internal_id, n, o, list_sort(x) = list_sort(y) or (least(len(x), len(y)) >= 2 and x[-1] = y[-1] and left(x[1], 1) = left(y[1], 1) and (length(x[1]) = 1 or length(y[1]) = 1)) or (len(list_intersect(x, y)) = least(len(x), len(y)) and least(len(x), len(y)) >= 2) compatible from p""")
def compatible_player_names(t: Tables) -> DataFrame:
    """Pairs of spellings of one fixture's home side that can be the same name."""
    names = t.fixture_record.select("internal_id", X.transliterated_name("home_name").alias("n")).distinct()
    pairs = names.join(names.withColumnRenamed("n", "o"), "internal_id").where("n < o")
    return pairs.select("internal_id", "n", "o", X.compatible_names(F.col("n"), F.col("o")).alias("compatible"))


@query("select fixture_id, arg_max(home_xg, performance_id) home_xg from fixture_performance where home_xg is not null group by 1")
def last_known_value(t: Tables) -> DataFrame:
    return t.fixture_performance.where("home_xg is not null").groupBy("fixture_id").agg(F.max_by("home_xg", "performance_id").alias("home_xg"))


@query("with n as (select internal_id, snapshot_no, source_id, row_number() over (partition by internal_id order by snapshot_no desc, loaded_at desc, source_id desc) rn from fixture_snapshot) select internal_id, source_id from n where rn = 1")
def merged_snapshots(t: Tables) -> DataFrame:
    order = [F.desc("snapshot_no"), F.desc("loaded_at"), F.desc("source_id")]
    return upsert.last_write(t.fixture_snapshot, ["internal_id"], order).select("internal_id", "source_id")
