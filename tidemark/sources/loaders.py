"""Deliveries of providers, wide or nested, to flat rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_matches(df: DataFrame, keep: Sequence[str], zone: str) -> DataFrame:
    """``<keep>, season, kickoff_us, team, goals, is_home``: a row a side from results with a column a side. The season
    is the last four digits of the file's ``url``, ``Date`` and ``Time`` are local to ``zone``; rows without a readable
    time or season have null there."""
    local = F.to_timestamp(F.concat_ws(" ", "Date", "Time"), "dd/MM/yyyy HH:mm")
    side = lambda team, goals, home: F.struct(F.col(team).alias("team"), F.col(goals).cast("int").alias("goals"), F.lit(home).alias("is_home"))
    season = F.nullif(F.regexp_extract("url", r"(\d{4})\.csv$", 1), F.lit(""))
    rows = df.select(*keep, season.alias("season"), F.unix_micros(F.to_utc_timestamp(local, zone)).alias("kickoff_us"), F.explode(F.array(side("HomeTeam", "FTHG", True), side("AwayTeam", "FTAG", False))).alias("x"))
    return rows.select(*keep, "season", "kickoff_us", "x.*")


def nested_rows(df: DataFrame, url: str, pattern: str, body: str, field: str, kind: str) -> DataFrame:
    """``record_id, ordinal`` and the fields of each element of the array ``field`` of a JSON document; the record's id
    is the pattern's first group in the document's URL. A document without the array, or that isn't JSON, has none."""
    parsed = df.select(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).alias("record_id"), F.from_json(body, f"{field} {kind}")[field].alias("x"))
    return parsed.select("record_id", F.posexplode("x").alias("ordinal", "e")).select("record_id", F.col("ordinal").cast("long").alias("ordinal"), "e.*")


def zipped(df: DataFrame, arrays: Mapping[str, str]) -> DataFrame:
    """Parallel arrays written as JSON text, ``column: name of its element``, to a row for each place; where one is
    shorter its elements are null."""
    keep = [c for c in df.columns if c not in arrays]
    parsed = df.select(*keep, F.arrays_zip(*[F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(n) for c, n in arrays.items()]).alias("z"))
    return parsed.select(*keep, F.posexplode("z").alias("ordinal", "e")).select(*keep, F.col("ordinal").cast("long").alias("ordinal"), *[F.col("e")[n].alias(n) for n in arrays.values()])


def typed(df: DataFrame, column: str, kinds: Mapping[str, str]) -> DataFrame:
    """``df`` with a column for each listed type of a JSON list of ``{type, value}``, in its kind; missing or unreadable
    values are null, of a repeated type the last counts."""
    entries = F.from_json(column, "array<struct<type:string,value:string>>")
    last = lambda name: F.get(F.reverse(F.filter(entries, lambda e: e["type"] == name)), F.lit(0))["value"].try_cast(kinds[name])
    return df.withColumns({name: last(name) for name in kinds})


def observations(df: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """``key, kind, value``: a row for each of the ``values`` that a row states."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in values.items()])
    return df.select(key, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.*")
