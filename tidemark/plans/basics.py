"""Registered queries on small operators: lists, maps, columns, parsing, times, seeds, counts and stored tables."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators import checks, joins, ledger
from tidemark.plans.registry import Registry, Tables
from tidemark.session import own_folder
from tidemark.sources import artifacts, readers
from tidemark.streaming import pipelines as stream

R = Registry()
query = R.query
MARKETING = ("BUILDING", "MACHINERY")
STATUS = {"FT": "finished", "AET": "finished", "PEN": "finished", "NS": "scheduled", "TBD": "scheduled", "PST": "postponed", "CANC": "cancelled", "ABD": "abandoned"}


def scratch(t: Tables, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{own_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_custkey not in (select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))")
def key_lists(t: Tables) -> DataFrame:
    urgent = joins.in_keys(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    listed = joins.in_keys(t.customer, "c_mktsegment", MARKETING).select(F.col("c_custkey").alias("o_custkey"))
    return urgent.join(listed, "o_custkey", "left_anti").select("o_orderkey")


@query("select record_no from fixture_record where source_id like 'lw%'")
def prefix_match(t: Tables) -> DataFrame:
    return t.fixture_record.where(F.col("source_id").startswith("lw")).select("record_no")


@query("select * replace (upper(r_name) as r_name) from region")
def replaced_columns(t: Tables) -> DataFrame:
    return t.region.withColumns({"r_name": F.upper("r_name")})


@query("select * exclude (n_regionkey) from nation")
def excluded_columns(t: Tables) -> DataFrame:
    return t.nation.drop("n_regionkey")


@query("select record_no, case when upper(trim(status)) in ('FT', 'AET', 'PEN') then 'finished' when upper(trim(status)) in ('NS', 'TBD') then 'scheduled' when upper(trim(status)) = 'PST' then 'postponed' when upper(trim(status)) = 'CANC' then 'cancelled' when upper(trim(status)) = 'ABD' then 'abandoned' else 'unknown' end as status from fixture_record")
def status_codes(t: Tables) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return t.fixture_record.select("record_no", F.coalesce(known[F.upper(F.trim("status"))], F.lit("unknown")).alias("status"))


@query("select corner_fixture_id from corner_target where competition_id in (select competition_id from score_target group by 1 having count(*) > 100) or lower(home_name) || '|' || lower(away_name) in (select lower(home_name) || '|' || lower(away_name) from fixture_record where status = 'FT')")
def monitored_scope(t: Tables) -> DataFrame:
    """By id or by a normalised key; each a semi-join of its own, so neither becomes a nested loop."""
    ids = t.score_target.groupBy("competition_id").count().where("count > 100").select("competition_id", F.lit(True).alias("by_id"))
    key = F.concat_ws("|", F.lower("home_name"), F.lower("away_name")).alias("key")
    names = t.fixture_record.where("status = 'FT'").select(key).distinct().withColumn("by_name", F.lit(True))
    return t.corner_target.select("corner_fixture_id", "competition_id", key).join(ids, "competition_id", "left").join(names, "key", "left").where("by_id or by_name").select("corner_fixture_id")


@query("select a.record_no, b.record_no other from fixture_record a join fixture_record b on b.internal_id = a.internal_id and b.record_no > a.record_no and b.status <> a.status")
def residual_conflicts(t: Tables) -> DataFrame:
    f = t.fixture_record.select("record_no", "internal_id", "status")
    return f.join(f.toDF("other", "internal_id", "s"), "internal_id").where("other > record_no and s <> status").select("record_no", "other")


@query("select l_orderkey, l_linenumber, p_brand from lineitem join part on p_partkey = l_partkey")
def checked_lookup(t: Tables) -> DataFrame:
    return joins.lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), ["l_partkey"]).drop("l_partkey")


@query("""with f as (select fixture_id, information_state, feature_version, min(home_xg_attack) x, count(*) n from rich_rate_feature group by all)
    select prediction_id, x home_xg_attack from walk_forward_prediction p join f on f.fixture_id = p.fixture_id and f.information_state = p.information_state where n = 1 and kickoff >= timestamptz '2022-01-01 00:00:00+00' and kickoff < timestamptz '2024-01-01 00:00:00+00'""")
def two_file_scan(t: Tables) -> DataFrame:
    """Two Parquet files joined on two keys within a range of kick-offs, which reaches the scan."""
    return joins.bounded_pair(t.walk_forward_prediction.select("prediction_id", "fixture_id", "information_state", "kickoff"), t.rich_rate_feature.select("fixture_id", "information_state", "home_xg_attack"), ["fixture_id", "information_state"], "kickoff", "2022-01-01 00:00:00", "2024-01-01 00:00:00").select("prediction_id", "home_xg_attack")


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "score_target", "corner_target", "fixture_record")


@query(" union all ".join(f"select '{n}' table_name, count(*) n from {n}" for n in COUNTED))
def table_counts(t: Tables) -> DataFrame:
    out = None
    for n in COUNTED:
        part = getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("""with i as (select 'no_status' code, 'warning' severity, count(*) n from fixture_record where status is null union all select 'no_kickoff', 'error', count(*) from fixture_record where kickoff is null
    union all select 'no_zone', 'info', count(*) from fixture_record where venue_zone is null) select code, n, row_number() over (order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, code) place from i""")
def alerts_by_priority(t: Tables) -> DataFrame:
    rules = {"no_status": ("warning", "status"), "no_kickoff": ("error", "kickoff"), "no_zone": ("info", "venue_zone")}
    one = t.fixture_record.agg(*[F.count_if(F.col(c).isNull()).alias(code) for code, (_, c) in rules.items()])  # one row of counts
    each = F.array(*[F.struct(F.lit({"error": 0, "warning": 1, "info": 2}[s]).alias("rank"), F.lit(code).alias("code"), F.col(code).alias("n")) for code, (s, _) in rules.items()])
    return one.select(F.posexplode(F.array_sort(each)).alias("i", "a")).select("a.code", "a.n", (F.col("i") + 1).cast("bigint").alias("place"))


QUESTIONS = """select corner_fixture_id id, unnest([
    {'k': 'win', 's': 'home', 'line': null::double, 'h': null::int, 'a': null::int}, {'k': 'draw', 's': null, 'line': null, 'h': null, 'a': null}, {'k': 'handicap', 's': 'away', 'line': 1.5, 'h': null, 'a': null},
    {'k': 'team_total', 's': 'away', 'line': 1.5, 'h': null, 'a': null}, {'k': 'total', 's': null, 'line': home_corners + 0.5, 'h': null, 'a': null}, {'k': 'both_score', 's': null, 'line': null, 'h': null, 'a': null},
    {'k': 'exact', 's': null, 'line': null, 'h': home_corners, 'a': away_corners}]) q from corner_target where lower(trim(home_name)) <> lower(trim(away_name))"""


@query(f"select id corner_fixture_id, q.k kind, q.s side, q.line, q.h home_score, q.a away_score from ({QUESTIONS})")
def market_questions(t: Tables) -> DataFrame:
    """The seven templates of market questions, written from known parts and parsed back."""
    h, a, n = F.trim("home_name"), F.trim("away_name"), F.col("home_corners").cast("string")
    texts = [F.concat(F.lit("Will "), h, F.lit(" win on 2026-07-20?")), F.concat(F.lit("Will "), h, F.lit(" vs. "), a, F.lit(" end in a draw?")), F.concat(F.lit("Spread: "), a, F.lit(" (-1.5)")), F.concat(h, F.lit(" vs. "), a, F.lit(": "), a, F.lit(" O/U 1.5")), F.concat(h, F.lit(" vs. "), a, F.lit(": O/U "), n, F.lit(".5")), F.concat(h, F.lit(" vs. "), a, F.lit(": Both Teams to Score")), F.concat(F.lit("Exact Score: "), h, F.lit(" "), n, F.lit(" - "), F.col("away_corners").cast("string"), F.lit(" "), a, F.lit("?"))]
    asked = t.corner_target.where(F.lower(h) != F.lower(a)).select("corner_fixture_id", h.alias("home"), a.alias("away"), F.explode(F.array(*texts)).alias("question"))
    return asked.select("corner_fixture_id", X.market_question(F.col("question"), F.col("home"), F.col("away")).alias("q")).select("corner_fixture_id", "q.*")


@query("select target_row_id, list_transform(coalesce(agreeing_source_codes, []), lambda x: coalesce(x, '')) codes from score_target where len(coalesce(agreeing_source_codes, [])) <> 1 union all select target_row_id, [agreeing_source_codes[1]] from score_target where len(agreeing_source_codes) = 1 and agreeing_source_codes[1] is not null and agreeing_source_codes[1] <> '' union all select target_row_id, [] from score_target where len(agreeing_source_codes) = 1 and (agreeing_source_codes[1] is null or agreeing_source_codes[1] = '')")
def tolerant_lists(t: Tables) -> DataFrame:
    """Lists delivered as JSON text, as a bare word where there is one element, or not at all."""
    codes = F.transform("agreeing_source_codes", lambda x: F.coalesce(x, F.lit("")))
    text = F.when(F.size(codes) == 1, codes[0]).otherwise(F.to_json(codes))
    return t.score_target.select("target_row_id", X.text_list(text).alias("codes"))


@query("select event_id, epoch_us(ts) us from events")
def seconds_to_times(t: Tables) -> DataFrame:
    seconds = t.events.select("event_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(7,0)")).alias("s"))
    return seconds.select("event_id", F.unix_micros(F.timestamp_seconds("s")).alias("us"))


@query("select prediction_id, cast(cast(timezone('America/New_York', prediction_at) as date) as varchar) on_day from walk_forward_prediction")
def local_dates(t: Tables) -> DataFrame:
    return t.walk_forward_prediction.select("prediction_id", F.to_date(F.from_utc_timestamp("prediction_at", "America/New_York")).cast("string").alias("on_day"))


@query("select fold_key, model_key, cast(20260714 + cast('0x' || substr(sha256(model_key || '|' || fold_key), 1, 16) as ubigint)::hugeint as varchar) seed from (select distinct fold_key, model_key from walk_forward_prediction)")
def label_seeds(t: Tables) -> DataFrame:
    return t.walk_forward_prediction.select("fold_key", "model_key").distinct().withColumn("seed", X.label_seed(20260714, "model_key", "fold_key").cast("string"))


@query("select target_row_id, cast(unnest(range(2 * least(home_goals, 3), 2 * least(home_goals, 3) + 5)) as double) / 4 line from score_target where home_goals is not null")
def quarter_lines(t: Tables) -> DataFrame:
    low = 2 * F.least("home_goals", F.lit(3)) / 4
    return t.score_target.where("home_goals is not null").select("target_row_id", F.explode(X.quarter_lines(low, low + 1)).alias("line"))


@query("select p_partkey, cast(trunc(try_cast(p_retailprice as double)) as bigint) whole from part")
def whole_numbers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.whole_number(F.col("p_retailprice").cast("string")).alias("whole"))


@query("select l_orderkey, l_linenumber, cast(round_even(cast(l_quantity as int) * cast(l_discount * 1000 as int) / 100.0, 0) as bigint) completed from lineitem where l_discount > 0")
def percent_passes(t: Tables) -> DataFrame:
    total, share = F.col("l_quantity").cast("int"), F.concat((F.col("l_discount") * 1000).cast("int").cast("string"), F.lit("%"))
    return t.lineitem.where("l_discount > 0").select("l_orderkey", "l_linenumber", X.passes_completed(total, share).alias("p")).select("l_orderkey", "l_linenumber", F.col("p")[F.lit("completed")].cast("bigint").alias("completed"))


@query("with x as (select trim(regexp_replace(lower(home_name), '[^a-z0-9]+', ' ', 'g')) n, record_no from fixture_record), y as (select record_no, n, regexp_replace(regexp_replace(n, '^(?:(?:fc|ac|sc|cd) ){1,2}', ''), '(?: (?:fc|town|city|united|rovers)){1,2}$', '') b from x) select record_no, case when b = '' then n else b end bare from y")
def names_without_affixes(t: Tables) -> DataFrame:
    n = t.fixture_record.select("record_no", X.ascii_name(F.col("home_name")).alias("n"))
    front = F.regexp_replace("n", r"^(?:(?:fc|ac|sc|cd) ){1,2}", "")
    bare = F.regexp_replace(front, r"(?: (?:fc|town|city|united|rovers)){1,2}$", "")
    return n.select("record_no", F.when(bare == "", F.col("n")).otherwise(bare).alias("bare"))


@query("select count(*) n, cast(sum(o_custkey) as bigint) keys from orders where o_orderstatus = 'F'")
def temporary_view(t: Tables) -> DataFrame:
    name = f"targets_{uuid.uuid4().hex}"
    t.orders.where("o_orderstatus = 'F'").select("o_custkey").createOrReplaceTempView(name)
    return t.spark.sql(f"select count(*) n, sum(o_custkey) keys from {name}")


@query("select * from (values ('orders', true), ('no_such_table', false)) v(table_name, there)")
def table_probe(t: Tables) -> DataFrame:
    """Which of some names the catalogue has."""
    view = f"orders_{uuid.uuid4().hex}"
    t.orders.createOrReplaceTempView(view)
    rows = [("orders", t.spark.catalog.tableExists(view)), ("no_such_table", t.spark.catalog.tableExists("no_such_table"))]
    t.spark.catalog.dropTempView(view)
    return t.spark.createDataFrame(rows, "table_name string, there boolean")


def _region(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")


_REGION = "select c_custkey, c_mktsegment, c_acctbal from customer"
_SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])


@query(_REGION)
def csv_scan(t: Tables) -> DataFrame:
    _region(t).write.option("header", True).option("compression", "gzip").csv(path := scratch(t, "csv"))
    df = readers.read_csv(t.spark, path)
    return df.select(F.col("c_custkey").cast("long"), "c_mktsegment", F.col("c_acctbal").cast("double"))


@query(_REGION)
def json_lines_scan(t: Tables) -> DataFrame:
    _region(t).write.json(path := scratch(t, "json"))
    return readers.read_json_lines(t.spark, path, _SCHEMA).where("_bad is null").drop("_bad")


@query(_REGION)
def compressed_json_scan(t: Tables) -> DataFrame:
    """Whole gzipped files, a JSON document a line."""
    _region(t).write.option("compression", "gzip").json(path := scratch(t, "json-gz"))
    lines = readers.read_compressed_json(t.spark, f"{path}/*.gz").select(F.explode(F.split(F.rtrim("payload"), "\n")).alias("line"))
    return lines.where("line != ''").select(F.from_json("line", _SCHEMA).alias("r")).select("r.*")


@query(_REGION)
def schema_checked_scan(t: Tables) -> DataFrame:
    _region(t).write.parquet(path := scratch(t, "parquet"))
    return readers.read_parquet(t.spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in _region(t).schema]))


@query("select target_row_id, fixture_id, home_goals, away_goals from score_target")
def frozen_table(t: Tables) -> DataFrame:
    """A table frozen with its manifest, replaced by itself in one step, verified and thawed."""
    df, path = t.score_target.select("target_row_id", "fixture_id", "home_goals", "away_goals"), scratch(t, "frozen")
    artifacts.freeze(df, path, ["target_row_id"], ["fixture_id", "target_row_id"])
    artifacts.freeze(df, path, ["target_row_id"], ["fixture_id", "target_row_id"])
    return artifacts.thaw(t.spark, path)


@query("select source_code, count(*) bodies from (select distinct source_code, source_name from data_source) group by 1")
def raw_contents(t: Tables) -> DataFrame:
    """Every source's row stored as raw content, twice; the catalogue tells each content once."""
    root = scratch(t, "raw")
    for r in sorted(t.data_source.collect()):  # a table of fixed size
        for day in ("2024-05-01", "2024-05-02"):
            artifacts.store_raw(t.spark, root, r.source_code, "sources", r.source_name.encode(), f"{day}T00:00:00Z")
    schema = "source_code string, resource string, retrieved_at string, http_status int, content_sha256 string, duplicate_content boolean"
    found = readers.raw_catalogue(t.spark, root, T.StructType.fromDDL(schema))
    return found.groupBy("source_code").agg(F.count(F.lit(1)).alias("bodies"))


@query("select fold_key, count(*) n from walk_forward_prediction group by 1")
def ledger_file(t: Tables) -> DataFrame:
    """A ledger committed to a file in two appends, read back and verified link by link."""
    rows = [r.asDict() for r in t.walk_forward_prediction.groupBy("fold_key").agg(F.count(F.lit(1)).alias("n")).orderBy("fold_key").collect()]  # one row a month
    path = scratch(t, "ledger")
    ledger.commit(t.spark, path, rows[: len(rows) // 2])
    ledger.commit(t.spark, path, rows[len(rows) // 2 :])
    return ledger.read(t.spark, path, "fold_key string, n long").select("fold_key", "n")


@query("select '| ' || model_key || ' | ' || count(*) || ' |' line from walk_forward_prediction group by model_key union all select '| model | n |' union all select '|-|-|'")
def markdown_report(t: Tables) -> DataFrame:
    per = t.walk_forward_prediction.groupBy("model_key").agg(F.count(F.lit(1)).alias("n")).orderBy("model_key")
    return t.spark.createDataFrame([(line,) for line in checks.markdown(per, {"model_key": "model", "n": "n"})], "line string")


@query("""with c as (select snapshot_no, internal_id, row_number() over (partition by snapshot_no, internal_id order by loaded_at desc) rn, snapshot_at from fixture_snapshot), m as (select max(snapshot_at) now from fixture_snapshot)
    select snapshot_no, count(*) fixtures, (select epoch(now) from m) - epoch(max(snapshot_at)) age_seconds, (select epoch(now) from m) - epoch(max(snapshot_at)) > 30 * 86400 stale from c where rn = 1 group by snapshot_no""")
def snapshot_freshness(t: Tables) -> DataFrame:
    per = t.fixture_snapshot.groupBy("snapshot_no").agg(F.count_distinct("internal_id").alias("fixtures"), F.unix_micros(F.max("snapshot_at")).alias("at"))
    age = (F.col("now") - F.col("at")) / 1e6
    return per.crossJoin(per.agg(F.max("at").alias("now"))).select("snapshot_no", "fixtures", age.alias("age_seconds"), (age > 30 * 86400).alias("stale"))  # one row a delivery


@query("select fixture_id, max(epoch_us(prediction_at)) due_us from walk_forward_prediction where prediction_at <= timestamptz '2023-06-01 00:00:00+00' group by 1")
def latest_due_stages(t: Tables) -> DataFrame:
    """Of all stages that are due by now only the latest of each fixture runs."""
    stages = t.walk_forward_prediction.select("fixture_id", F.unix_micros("prediction_at").alias("due_us"))
    return stream.latest_due(stages, ["fixture_id"], "due_us", 1_685_577_600_000_000).select("fixture_id", "due_us")


@query("select prediction_id from walk_forward_prediction")
def asserted_predictions(t: Tables) -> DataFrame:
    """Predictions that passed the fail-closed checks: unique ids, probabilities that sum to one, none after its time."""
    p = checks.assert_unique(t.walk_forward_prediction, ["prediction_id"])
    each = p.select("prediction_id", F.explode(F.array("home_win_probability", "draw_probability", "away_win_probability")).alias("p"))
    checks.assert_simplex(each, ["prediction_id"], "p", 0.001)
    checks.assert_before(p.select(F.unix_micros("prediction_at").alias("us")), "us", 4_102_444_800_000_000)
    return p.select("prediction_id")


@query("select * from (values ('horizon_hours', 24.0), ('prior_goals', 1.25)) v(name, number)")
def checked_config(t: Tables) -> DataFrame:
    """Settings read from JSON, refused where they break an invariant."""
    path = scratch(t, "config")
    artifacts.put(t.spark, path, json.dumps({"horizon_hours": 24.0, "prior_goals": 1.25}).encode())
    config = readers.checked_config(path, {"horizon_hours": lambda x: x > 0, "prior_goals": lambda x: 0 < x < 10}, t.spark)
    return t.spark.createDataFrame(sorted(config.items()), "name string, number double")


@query("select * from (values ('score_target', true), ('corner_target', true), ('data_source', false)) v(table_name, reproduced)")
def manifest_check(t: Tables) -> DataFrame:
    """Tables against the digests that a manifest has of them; one is given as another table's."""
    digest = lambda df: ledger.table_digest(df, df.columns).first()["digest"]
    columns = {"score_target": ["target_row_id", "home_goals"], "corner_target": ["corner_fixture_id", "home_corners"], "data_source": ["source_code"]}
    actual = {n: digest(getattr(t, n).select(*c)) for n, c in columns.items()}
    manifest = {n: digest(getattr(t, n).select(*c).repartition(3)) for n, c in columns.items()} | {"data_source": actual["score_target"]}
    return t.spark.createDataFrame([(n, manifest[n] == actual[n]) for n in columns], "table_name string, reproduced boolean")


def _events(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    df = stream.parquet_stream(t.spark, path if os.path.isdir(path) else f"{t.sf_dir}/events*.parquet", t.events.schema)
    return df.withColumn("at", F.col("ts").cast("timestamp"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) where rn = 1")
def stream_upserts(t: Tables) -> DataFrame:
    """A stream merged batch by batch into a versioned table; each key ends with its latest row."""
    path = scratch(t, "upserts")
    order = F.struct("ts", "event_id").alias("o")
    sink = stream.upsert_sink(t.spark, path, ["user_id", "event_type"], "o", {"event_id": "replace"})
    _events(t).select("user_id", "event_type", "event_id", order).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(stream.latest_version(t.spark, path))


@query("""with o as (select event_type, epoch_us(ts) us from events), g as (select *, coalesce(us - lag(us) over (partition by event_type order by us) >= 1800000000, true)::int fresh from o), s as (select *, sum(fresh) over (partition by event_type order by us rows between unbounded preceding and current row) k from g)
    select event_type, min(us) start_us, max(us) + 1800000000 end_us, count(*) n from s group by event_type, k""")
def stream_sessions(t: Tables) -> DataFrame:
    """Runs of events with gaps below half an hour."""
    found = stream.run_to_table(stream.sessions(_events(t), "at", "30 minutes", ["event_type"], "1 day"), scratch(t, "sessions"), "complete")
    return found.select("event_type", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("select event_type, (epoch_us(ts) // 10800000000 - i.range) * 10800000000 start_us, count(*) n from events, range(2) i group by all")
def stream_sliding_windows(t: Tables) -> DataFrame:
    found = stream.run_to_table(stream.sliding(_events(t), "at", "6 hours", "3 hours", ["event_type"], "1 day"), scratch(t, "sliding"), "complete")
    return found.select("event_type", F.unix_micros("window_start").alias("start_us"), "n")
