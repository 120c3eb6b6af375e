import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.streaming import pipelines as P

S = "id long, k long, at timestamp, v double"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i % 40, i % 3, 1_700_000_000 + i * 600, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, s long, v double").select("id", "k", F.timestamp_seconds("s").alias("at"), "v")
    for part in range(4):
        df.where(F.floor(F.unix_seconds("at") / 600) % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path), df


def test_streams_equal_batch(spark, folder):
    root, df = folder
    s = lambda: P.parquet_stream(spark, f"{root}/in", df.schema)
    assert P.run_to_memory(P.unique_within(s(), ["id"], "at", "30 days"), "u", "append", f"{root}/c1").count() == 40
    w = P.run_to_memory(P.tumbling(s(), "at", "1 hour", ["k"], "v", "30 days"), "w", "complete", f"{root}/c2")
    want = df.groupBy(F.window("at", "1 hour").start.alias("w"), "k").agg(F.count(F.lit(1)), F.sum("v"))
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, want.collect()))
    st = P.run_to_memory(P.running_state(s(), "k", "at", "v"), "st", "update", f"{root}/c3").groupBy("key").agg(F.max("n").alias("n"), F.max_by("last", "n").alias("last"))
    want = df.groupBy("k").agg(F.count(F.lit(1)), F.max_by("v", "at"))
    assert sorted(map(tuple, st.collect())) == sorted(map(tuple, want.collect()))


def test_upsert_sink_is_idempotent(spark, folder):
    root, df = folder
    sink = P.upsert_sink(spark, f"{root}/out", ["k"], "at", {"v": "replace"})
    sink(df.where("k < 2"), 0)
    sink(df, 1)
    sink(df, 1)
    got = spark.read.parquet(f"{root}/out/v2")
    want = df.groupBy("k").agg(F.max_by("v", "at"))
    assert sorted(map(tuple, got.select("k", "v").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_go_aside(spark, folder):
    _, df = folder
    ok, late = P.split_late("at", "deadline", "1 hour")(df.withColumn("deadline", F.timestamp_seconds(F.lit(1_700_003_600))))
    assert (ok.count(), late.count()) == (6, 54)


def test_latest_due(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9)], "k string, due long")
    assert [r.due for r in P.latest_due(df, ["k"], "due", 5).collect()] == [2]


def test_replay_of_a_stream_is_the_replay_of_all(spark):
    from tidemark.plans.catalogue import QUERIES

    told = lambda name: {r.fixture_id: tuple(r) for r in QUERIES[name](spark, SMALL).collect()}
    whole, streamed = told("state_replay_goals"), told("stream_state_replay")
    assert whole.keys() == streamed.keys() and len(whole) > 1000
    assert all(whole[k] == pytest.approx(streamed[k]) for k in whole)
