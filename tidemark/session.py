"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shipped tables; a single file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one is set only where none is given,
    which is only right on one machine."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        pass


def own_folder(spark: SparkSession) -> str:
    """The session's folder in the shared checkpoint folder; it is removed when the session ends."""
    folder = f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it from there, so that later stages neither
    repeat its work nor depend on one executor's disk, read only the columns they need, and are planned with its true
    size. The tables of a session are removed at its end."""
    spark = df.sparkSession
    folder = own_folder(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables of the session that cut lineage; frames made before can't be read any more."""
    for folder in sorted(f for f in _folders if f.endswith(spark.sparkContext.applicationId)):
        _remove(spark, folder)


def cores(spark: SparkSession) -> int:
    """Task slots of the session."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """As many partitions as keep all cores busy with work on the CPU. An input large enough to be read in as many is
    left alone; its size is that of the plan's statistics, so nothing runs to find it."""
    least = least or 3 * cores(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(least) if size < least * df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df
