"""The registered queries of the problems solved in this subpackage, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.best_record import best_representative
from tidemark.llm.bin_fill import container_use, fill_containers
from tidemark.llm.entity_match import match_fixtures
from tidemark.llm.leakage import leaked_items
from tidemark.llm.nearest_time import nearest_in_time
from tidemark.llm.residue import residue
from tidemark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_representative(
        table(spark, sf_dir, "score_target"), table(spark, sf_dir, "data_source"), table(spark, sf_dir, "target_exclusion"), group="fixture_id",
        value=("home_goals", "away_goals"), trust="agreeing_source_codes", recency="source_max_retrieved_at", fill="season_id", observed="observed_scores",
    ).select("fixture_id", "home_goals", "away_goals", "season_id", "source_codes")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_fixtures(table(spark, sf_dir, "fixture_record"), table(spark, sf_dir, "corner_target"), table(spark, sf_dir, "data_source")).select("corner_fixture_id", "internal_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_in_time(
        table(spark, sf_dir, "walk_forward_prediction"), table(spark, sf_dir, "external_market_quote"), left_id="prediction_id", left_entity="fixture_id",
        left_time="prediction_at", right_id="quote_id", right_entity="fixture_id", right_time="observed_at",
    ).select(F.col("left_id").alias("prediction_id"), F.col("right_id").alias("quote_id"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_container"), doc_id="doc_id", text="text", kind="container_kind", capacity="capacity_tokens")


def p8_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).withColumnRenamed("doc", "doc_id")


def p8_container_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_use(_filled(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"), doc_id="doc_id", text="text", item_id="item_id", item_text="text", item_answer="answer"
    ).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").select(F.col("doc").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p7_found, p8_assignments, p8_container_use, p9_found, p10_found)}

SQL = {
    "p1_found": """
        with r as (select fixture_id g, case when away_goals is not null then home_goals end h, case when home_goals is not null then away_goals end a,
                          season_id, agreeing_source_codes c, source_max_retrieved_at t from score_target where fixture_id is not null),
        canon as (select regexp_replace(lower(source_code), '[^a-z0-9]', '', 'g') k, min(source_code) source_code from data_source group by 1),
        codes as (select g, h, a, array_agg(distinct source_code order by source_code) l
                  from (select g, h, a, regexp_replace(lower(unnest(c)), '[^a-z0-9]', '', 'g') k from r) join canon using (k) group by all),
        v as (select r.g, r.h, r.a, max(t) t, any_value(l) l from r left join codes c on c.g = r.g and c.h is not distinct from r.h and c.a is not distinct from r.a group by all),
        best as (select *, row_number() over (partition by g order by h is null, coalesce(len(l), 0) desc, t desc nulls last, h, a) rn from v),
        season as (select g, season_id, row_number() over (partition by g order by t desc nulls last, season_id desc) rn from r where season_id is not null),
        pairs as (select g, list_sort(array_agg(distinct {'home_goals': h, 'away_goals': a})) p from r where h is not null group by g)
        select best.g fixture_id, h home_goals, a away_goals, season.season_id, coalesce(array_to_string(l, ','), '') source_codes
        from best join (select g from r group by g having count(*) > 1) using (g) left join season on season.g = best.g and season.rn = 1
        where best.rn = 1 and not exists (select 1 from target_exclusion x, pairs where x.fixture_id = best.g and pairs.g = best.g and list_sort(list_distinct(x.observed_scores)) = pairs.p)""",
    "p7_found": """
        with c as (select p.prediction_id, q.quote_id, row_number() over (partition by p.prediction_id order by abs(epoch_us(q.observed_at) - epoch_us(p.prediction_at)), q.quote_id) rn
                   from walk_forward_prediction p join external_market_quote q on q.fixture_id = p.fixture_id and abs(epoch_us(q.observed_at) - epoch_us(p.prediction_at)) <= 1800000000)
        select prediction_id, quote_id from c where rn = 1""",
}
