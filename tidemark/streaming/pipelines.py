"""Structured Streaming twins of the batch operators: the same results for the same rows, in any number of batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.asof import latest_per_key
from tidemark.operators.replay import SNAPSHOT, Replay, ReplaySpec, fold
from tidemark.operators.upsert import upsert


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of every key within the watermark; the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], value: str, delay: str) -> DataFrame:
    """``window_start, <keys>, n, total`` of closed windows."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "total")
    )


def sliding(stream: DataFrame, time: str, width: str, slide: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Counts over sliding windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], delay: str) -> DataFrame:
    """``session_start, session_end, <keys>, n``: runs of rows with gaps below ``gap``."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def split_late(captured: str, deadline: str, window: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """Splits rows into those captured in ``[deadline - window, deadline)`` and all others, which are late or early and
    go to a side output."""

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        ok = (F.col(captured) < F.col(deadline)) & (F.col(captured) >= F.col(deadline) - F.expr(f"INTERVAL {window}"))
        return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))

    return split


def latest_due(stages: DataFrame, keys: Sequence[str], due: str, now: object) -> DataFrame:
    """Per key only the latest stage that is due, so that a backlog after downtime runs once."""
    return latest_per_key(stages.where(F.col(due) <= F.lit(now)), keys, [F.desc(due)])


def upsert_sink(spark: SparkSession, path: str, keys: Sequence[str], order: str, policies: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges every batch into a versioned table under ``path``: version n + 1 is
    written whole before it counts, and a batch that is delivered again finds its version there and does nothing."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def write(batch: DataFrame, batch_id: int) -> None:
        at, last = f"{path}/v{batch_id + 1}", f"{path}/v{batch_id}"
        fs = Path(path).getFileSystem(hadoop)
        if fs.exists(Path(f"{at}/_SUCCESS")):
            return
        new = latest_per_key(batch, keys, [F.desc(order)]).select(*keys, *policies)
        old = spark.read.parquet(last) if fs.exists(Path(f"{last}/_SUCCESS")) else new.where("1 = 0")
        upsert(old, new, keys, policies).write.mode("overwrite").parquet(at)

    return write


def latest_version(spark: SparkSession, path: str) -> str:
    """The folder of the last whole version that an :func:`upsert_sink` wrote under ``path``."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [f.getPath() for f in fs.listStatus(Path(path)) if fs.exists(Path(f"{f.getPath().toString()}/_SUCCESS"))]
    return max(whole, key=lambda p: int(p.getName()[1:])).toString()


SEEN = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("last", T.DoubleType())])


def running_state(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows so far and latest value by time of every key, updated with each batch; keyed state in the state store."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, last = state.get if state.exists else (0, None, None)
        for frame in frames:
            frame = frame.sort_values("_t", kind="stable")
            n += len(frame)
            if at is None or frame["_t"].iloc[-1] >= at:
                at, last = int(frame["_t"].iloc[-1]), float(frame["_v"].iloc[-1])
        state.update((n, at, last))
        yield pd.DataFrame([(int(k[0]), n, last)], columns=SEEN.names)

    held = T.StructType([T.StructField("n", T.LongType()), T.StructField("at", T.LongType()), T.StructField("last", T.DoubleType())])
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(F.col(time)).alias("_t"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy("key").applyInPandasWithState(update, SEEN, held, "update", GroupStateTimeout.NoTimeout)


def replayed(stream: DataFrame, spec: ReplaySpec) -> DataFrame:
    """The state replay over a stream of :func:`tidemark.operators.replay.replay_events`: a group's states are kept in the
    state store between batches. A batch is replayed in order of time; events of a time must come in one batch, and no
    later than those of later times, so the source delivers in order."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        replay = pickle.loads(state.get[0]) if state.exists else Replay(spec)
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["_t", "_phase", "fixture_id"], kind="stable")
        found = [f for f in fold([frame], spec, replay) if len(f)]
        state.update((pickle.dumps(replay),))
        yield from found

    held = T.StructType([T.StructField("replay", T.BinaryType())])
    return stream.groupBy("_g").applyInPandasWithState(update, SNAPSHOT, held, "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is available into an in-memory table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available into a table under ``path``: what each batch adds, changes (``update``:
    the later batches' rows beside the earlier ones) or, where ``complete``, the last batch's whole result. A batch
    that is delivered again writes its own folder again."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={0 if mode == 'complete' else batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data").select(*stream.columns)
