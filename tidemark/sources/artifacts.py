"""Frozen tables: sorted Parquet with a manifest, put in place in one step and verified; and raw content stores."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import CheckFailed
from tidemark.operators.ledger import table_digest


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one small file, in whatever file system it lies."""
    fs, Path = _fs(spark, path)
    out = fs.create(Path(path), True)
    out.write(bytearray(data))
    out.close()


def verify(df: DataFrame, keys: Sequence[str], time: str | None = None) -> DataFrame:
    """``rows, distinct_keys`` and the range of a time column, in one aggregation."""
    cells = [F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*keys)).alias("distinct_keys")]
    if time:
        cells += [F.min(time).alias("first"), F.max(time).alias("last")]
    return df.agg(*cells)


def freeze(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> dict:
    """Writes a table that stays as it is: sorted, zstd, into a temporary folder beside ``path``, verified there (every
    row written, keys unique), then renamed; an existing ``path`` is only replaced by a good one. Gives the manifest,
    which is also written beside it."""
    spark = df.sparkSession
    fs, Path = _fs(spark, path)
    beside = f"{path}.writing-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(beside)
    written = spark.read.parquet(beside)
    check = verify(written, keys).first()
    if check["rows"] != check["distinct_keys"]:
        fs.delete(Path(beside), True)
        raise CheckFailed(f"{check['rows'] - check['distinct_keys']} rows repeat a key of {list(keys)}")
    digest = table_digest(written, df.columns).first()
    manifest = {"rows": check["rows"], "columns": df.columns, "keys": list(keys), "order": list(order), "table_sha256": digest["digest"]}
    old = f"{path}.replaced-{uuid.uuid4().hex}"
    if fs.exists(Path(path)):
        fs.rename(Path(path), Path(old))
    if not fs.rename(Path(beside), Path(path)):
        raise OSError(f"{beside} can't be renamed to {path}")
    fs.delete(Path(old), True)
    put(spark, f"{path}.manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def thaw(spark: SparkSession, path: str) -> DataFrame:
    """A frozen table, after checking it against its manifest."""
    text = "\n".join(r[0] for r in spark.read.text(f"{path}.manifest.json").collect())
    manifest, df = json.loads(text), spark.read.parquet(path)
    if df.columns != manifest["columns"]:
        raise CheckFailed("columns differ from the manifest")
    digest = table_digest(df, df.columns).first()
    if (digest["rows"], digest["digest"]) != (manifest["rows"], manifest["table_sha256"]):
        raise CheckFailed("rows differ from the manifest")
    return df


def store_raw(spark: SparkSession, root: str, source: str, resource: str, body: bytes, retrieved_at: str, status: int = 200) -> dict:
    """Puts one retrieval into a content-addressed store in whatever file system ``root`` lies: the gzipped body once for
    its content, a sidecar for every retrieval."""
    fs, Path = _fs(spark, root)
    sha = hashlib.sha256(body).hexdigest()
    duplicate = fs.exists(Path(f"{root}/content/{sha}.gz"))
    if not duplicate:
        put(spark, f"{root}/content/{sha}.gz", gzip.compress(body, mtime=0))
    meta = {"source_code": source, "resource": resource, "retrieved_at": retrieved_at, "http_status": status, "content_sha256": sha, "duplicate_content": duplicate}
    put(spark, f"{root}/{source}/{resource}/ingest_date={retrieved_at[:10]}/{sha[:16]}-{uuid.uuid4().hex[:8]}.meta.json", json.dumps(meta).encode())
    return meta
