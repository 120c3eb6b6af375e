"""The registered queries of the data-preparation problems of the core: p2, p4, p5 and p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof_shards import known_before, team_versions
from tidemark.operators.nested import match_children, merkle_tables
from tidemark.operators.snapshot_diff import snapshot_changes
from tidemark.operators.timestamps import normalised_instants
from tidemark.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_children(merkle_tables(table(spark, sf_dir, "raw_match_payload"), "payload_id", "payload"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = team_versions(table(spark, sf_dir, "fixture_performance"), table(spark, sf_dir, "score_target"))
    return known_before(
        table(spark, sf_dir, "rich_rate_feature"), versions, event_id="feature_row_id", event_entity="home_team_id", event_time="prediction_at",
        version_entity="team", version_time="known_from", version_id="row_id", version_kind="kind", kinds=("performance", "result"),
    ).select(F.col("event_id").alias("feature_row_id"), "attribute_kind", "known_row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"status": F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")), "kickoff": F.unix_micros("kickoff"), "source_id": F.col("source_id")}
    found = snapshot_changes(table(spark, sf_dir, "fixture_snapshot"), snapshot="snapshot_no", key="internal_id", loaded="loaded_at", fields=fields)
    return found.select(F.col("key").alias("internal_id"), F.col("snapshot").alias("snapshot_no"), "change_kind")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = normalised_instants(table(spark, sf_dir, "fixture_record"), "record_no", "kickoff", "venue_zone", "fixture_record")
    quotes = normalised_instants(table(spark, sf_dir, "external_market_quote"), "quote_id", "retrieved_at", "feed_zone", "external_market_quote")
    return fixtures.unionByName(quotes)


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found}



def _objects(value: str) -> str:
    """SQL for the objects of a JSON field: its own or those of a list."""
    return f"(case json_type({value}) when 'OBJECT' then [{value}] when 'ARRAY' then list_filter(from_json({value}, '[\"json\"]'), lambda x: json_type(x) = 'OBJECT') else [] end)"


def _key(value: str) -> str:
    return f"coalesce({value}->>'id', {value}->>'name')"


SQL = {
    "p2_found": f"""
        with recursive u as (
          select payload_id, payload::json j from raw_match_payload where json_valid(payload)
          union all
          select payload_id, unnest(case when json_type(j) = 'ARRAY' then from_json(j, '["json"]') when json_type(j) = 'OBJECT' and json_exists(j, '$.response') then [case when json_type(j->'response') = 'VARCHAR' then (j->>'response')::json else j->'response' end] else [] end) from u),
        sec as (select payload_id, f section, j->f v from u, (values ('lineups'), ('players'), ('statistics')) s(f) where json_type(j) = 'OBJECT' and not json_exists(j, '$.response')),
        e as (select payload_id, section, unnest({_objects('v')}) e from sec),
        tm as (select * from (select payload_id, section, e, {_key('t')} tk from (select *, unnest({_objects("e->'team'")}) t from e)) where tk is not null),
        sq as (select payload_id, section, tk, unnest({_objects('v')}) s from (select *, unnest(case section when 'players' then [e->'players'] when 'lineups' then [e->'startXI', e->'substitutes'] else [] end) v from tm)),
        pl as (select payload_id, section, tk, s, {_key('p')} pk from (select *, unnest({_objects("s->'player'")}) p from sq)),
        ps as (select payload_id, pk, g, unnest(json_keys(g)) k from (select payload_id, pk, unnest({_objects("s->'statistics'")}) g from pl where section = 'players' and pk is not null)),
        ts as (select payload_id, tk, unnest({_objects("e->'statistics'")}) g from tm where section = 'statistics'),
        tk as (select payload_id, tk, g, unnest(json_keys(g)) k from ts where not json_exists(g, '$.type'))
        select distinct payload_id, case section when 'players' then 'player' else 'lineup' end child_table, tk parent_key, pk child_key from pl where pk is not null
        union select payload_id, 'player_stat', pk, k from ps where json_type(json_extract(g, '/' || replace(replace(k, '~', '~0'), '/', '~1'))) <> 'NULL'
        union select payload_id, 'team_stat', tk, g->>'type' from ts where json_exists(g, '$.type') and json_type(g->'value') <> 'NULL' and g->>'type' is not null
        union select payload_id, 'team_stat', tk, k from tk where json_type(json_extract(g, '/' || replace(replace(k, '~', '~0'), '/', '~1'))) not in ('NULL', 'OBJECT')""",
    "p4_found": """
        with v as (
          select 'performance' kind, performance_id id, available_at t, unnest([home_team_id, away_team_id]) team from fixture_performance where available_at is not null
          union all
          select 'result', target_row_id, result_available_at, unnest([home_team_id, away_team_id]) from score_target where result_available_at is not null),
        d as (select kind, team, t, min(id) id from v group by all)
        select f.feature_row_id, k.kind attribute_kind, d.id known_row_id
        from rich_rate_feature f cross join (values ('performance'), ('result')) k(kind)
        asof join d on d.kind = k.kind and d.team = f.home_team_id and d.t < f.prediction_at""",
    "p5_found": r"""
        with r as (
          select snapshot_no, internal_id, lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) s, kickoff k, source_id c,
                 row_number() over (partition by snapshot_no, internal_id order by loaded_at desc) rn from fixture_snapshot),
        c as (select * from r where rn = 1),
        p as (select n.snapshot_no, (select max(o.snapshot_no) from c o where o.snapshot_no < n.snapshot_no) before from (select distinct snapshot_no from c) n),
        old as (select p.snapshot_no, c.internal_id, c.s, c.k, c.c from p join c on c.snapshot_no = p.before),
        new as (select c.* from c join p using (snapshot_no) where p.before is not null)
        select coalesce(new.internal_id, old.internal_id) internal_id, coalesce(new.snapshot_no, old.snapshot_no) snapshot_no,
               case when old.internal_id is null then 'added' when new.internal_id is null then 'removed' else 'changed' end change_kind
        from new full join old on new.snapshot_no = old.snapshot_no and new.internal_id = old.internal_id
        where old.internal_id is null or new.internal_id is null or new.s is distinct from old.s or new.k is distinct from old.k or new.c is distinct from old.c""",
}
