"""Readers: schema-checked Parquet, JSON lines, compressed JSON and CSV, and a content-addressed raw catalogue."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """A file's columns aren't the expected ones."""


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, order: Sequence[str] = ()) -> DataFrame:
    """Parquet whose columns, in name, order and type, must be those of the schema."""
    df = spark.read.parquet(path)
    found, wanted = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if found != wanted:
        raise SchemaMismatch(f"{path}: {sorted({str(x) for x in found} ^ {str(x) for x in wanted}) or 'another order of columns'}")
    return df.orderBy(*order) if order else df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, bad: str = "_bad") -> DataFrame:
    """Newline-delimited JSON by an explicit schema; a line that isn't JSON is kept as text in ``bad``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).option("columnNameOfCorruptRecord", bad).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; a byte order mark and gzip are dealt with, missing fields are null."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for body in batch.column(1).to_pylist():
            try:
                while body[:2] == b"\x1f\x8b":
                    body = gzip.decompress(body)
                texts.append(body.decode("utf-8-sig"))
            except (OSError, EOFError, UnicodeDecodeError):
                texts.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "payload"])


def read_compressed_json(spark: SparkSession, path: str) -> DataFrame:
    """``path, payload`` of whole files, unzipped as often as they were zipped; null where that fails."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_unzip, "path string, payload string")


def raw_catalogue(spark: SparkSession, root: str, schema: T.StructType, *, source: str | None = None, resource: str | None = None, unique_content: bool = True) -> DataFrame:
    """Sidecars ``*.meta.json`` under a root, of successful retrievals only; of equal contents the first by path."""
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))
    found = found.where(F.col("http_status") == 200)
    for column, value in (("source_code", source), ("resource", resource)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if unique_content:
        found = found.withColumn("_rn", F.row_number().over(W.partitionBy("content_sha256").orderBy("path"))).where("_rn = 1").drop("_rn")
    return found


def field_coverage(df: DataFrame, payload: str, paths: Sequence[str]) -> DataFrame:
    """``path, present, filled``: in how many JSON payloads a dotted path exists, and isn't null. One pass for all paths.
    A payload that isn't JSON has none."""
    v = F.try_parse_json(F.col(payload))
    cells = []
    for i, p in enumerate(paths):
        got = F.try_variant_get(v, "$." + p, "variant")
        cells += [F.count_if(got.isNotNull()).alias(f"p{i}"), F.count_if(got.isNotNull() & ~F.is_variant_null(got)).alias(f"f{i}")]
    rows = df.agg(*cells)
    return rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"p{i}").alias("present"), F.col(f"f{i}").alias("filled")) for i, p in enumerate(paths)])).alias("x")).select("x.*")


def json_config(path: str | Path, spark: SparkSession | None = None) -> dict:
    """A JSON document of the driver's file system or, by a session, of any that it can read."""
    return json.loads(spark.read.text(str(path), wholetext=True).first()[0] if spark else Path(path).read_text(encoding="utf-8"))


def checked_config(path: str | Path, invariants: Mapping[str, Callable[[object], bool]], spark: SparkSession | None = None) -> dict:
    """:func:`json_config` with exactly the named settings, each of which holds its invariant; else an error names it."""
    config = json_config(path, spark)
    if odd := sorted(set(config) ^ set(invariants)):
        raise ValueError(f"missing or unknown: {odd}")
    for name, holds in invariants.items():
        if not holds(config[name]):
            raise ValueError(f"{name} can't be {config[name]!r}")
    return config
