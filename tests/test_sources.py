import gzip
import json

import pytest
from pyspark.sql import types as T

from tidemark.operators.checks import CheckFailed
from tidemark.sources import artifacts, readers


def test_freeze_and_thaw(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    manifest = artifacts.freeze(df, path, ["k"], ["k"])
    assert manifest["rows"] == 2 and artifacts.thaw(spark, path).count() == 2
    with pytest.raises(CheckFailed):
        artifacts.freeze(df.unionAll(df), path, ["k"], ["k"])
    assert artifacts.thaw(spark, path).count() == 2, "a bad table must not replace a good one"
    spark.createDataFrame([(9, "z")], "k int, v string").write.mode("append").parquet(path)
    with pytest.raises(CheckFailed):
        artifacts.thaw(spark, path)


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    spark.createDataFrame([(1, "a")], schema).write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), schema, ["k"]).count() == 1
    with pytest.raises(readers.SchemaMismatch):
        readers.read_parquet(spark, str(tmp_path / "p"), T.StructType(schema.fields[::-1]))
    (tmp_path / "l.jsonl").write_text('{"k": 1, "v": "x"}\nnot json\n')
    got = readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), schema).collect()
    assert [r._bad for r in got] == [None, "not json"]
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress("﻿a,b\n1,\n".encode()))
    assert readers.read_csv(spark, str(tmp_path / "c.csv.gz")).collect()[0].asDict() == {"a": "1", "b": None}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/x.json.gz").write_bytes(gzip.compress(gzip.compress(b'{"a": 1}')))
    assert readers.read_compressed_json(spark, str(tmp_path / "j")).first().payload == '{"a": 1}'


def test_raw_store_and_catalogue(spark, tmp_path):
    for at in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"):
        artifacts.store_raw(spark, str(tmp_path), "s", "fixtures", b"body", at)
    artifacts.store_raw(spark, str(tmp_path), "s", "fixtures", b"gone", "2024-01-03T00:00:00Z", 404)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source_code", "resource", "retrieved_at", "content_sha256")] + [T.StructField("http_status", T.IntegerType())])
    assert readers.raw_catalogue(spark, str(tmp_path), schema, source="s").count() == 1
    assert readers.raw_catalogue(spark, str(tmp_path), schema, unique_content=False).count() == 2


def test_field_coverage(spark):
    df = spark.createDataFrame([(json.dumps({"a": {"b": 1}}),), (json.dumps({"a": {"b": None}}),), ("broken{",), (None,)], "payload string")
    got = {r.path: (r.present, r.filled) for r in readers.field_coverage(df, "payload", ["a.b", "a.c"]).collect()}
    assert got == {"a.b": (2, 1), "a.c": (0, 0)}
