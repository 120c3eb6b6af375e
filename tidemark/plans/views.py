"""Views that give the shipped order tables the roles of matches, observations and ticks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables


def minutes(column: str) -> Column:
    """Whole minutes since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def matches(t: Tables) -> DataFrame:
    """``fixture_id, home, away, competition, kick`` (minutes) ``, home_goals, away_goals``: an order is a match of its
    customer's and its first line's supplier's nations."""
    line = F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")).alias("l")
    first = t.lineitem.groupBy("l_orderkey").agg(line).select("l_orderkey", "l.*")
    o = t.orders.select("o_orderkey", "o_custkey", minutes("o_orderdate").alias("day"))
    return (
        o.join(first, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
        .where("c_nationkey <> s_nationkey")
        .select(
            F.col("o_orderkey").alias("fixture_id"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"), F.col("n_regionkey").alias("competition"),
            (F.col("day") + F.col("o_orderkey") % 1440).alias("kick"), (F.floor("l_quantity") % 5).cast("bigint").alias("home_goals"), (F.col("l_partkey") % 4).alias("away_goals"),
        )
    )


MATCHES = """ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) rn from lineitem),
m as (select o_orderkey fixture_id, c_nationkey home, s_nationkey away, n_regionkey competition, epoch_us(o_orderdate) // 60000000 + o_orderkey % 1440 kick,
             cast(floor(l_quantity) as bigint) % 5 home_goals, l_partkey % 4 away_goals
      from orders join ln on l_orderkey = o_orderkey and rn = 1 join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
      join nation on n_nationkey = c_nationkey where c_nationkey <> s_nationkey)"""


def team_rows(t: Tables) -> DataFrame:
    """A row for each side of a match: ``fixture_id, team, opponent, competition, kick, scored, conceded, is_home``."""
    side = lambda team, other, a, b, home: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.col(a).alias("scored"), F.col(b).alias("conceded"), F.lit(home).alias("is_home"))
    return matches(t).select("fixture_id", "competition", "kick", F.explode(F.array(side("home", "away", "home_goals", "away_goals", True), side("away", "home", "away_goals", "home_goals", False))).alias("s")).select("fixture_id", "competition", "kick", "s.*")


TEAM_ROWS = MATCHES + """,
tr as (select fixture_id, competition, kick, home team, away opponent, home_goals scored, away_goals conceded, true is_home from m
       union all select fixture_id, competition, kick, away, home, away_goals, home_goals, false from m)"""


def ticks(t: Tables) -> DataFrame:
    """Events with their time in seconds."""
    return t.events.select("event_id", "user_id", "event_type", "value", "props", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("sec"))


TICKS = "tk as (select event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 sec from events)"
