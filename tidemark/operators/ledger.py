"""Hashes of rows and tables, and hash-chained append-only ledgers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.checks import CheckFailed

GENESIS = "0" * 64


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as compact JSON with sorted fields; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows, digest`` of a table as a multiset: equal whatever the order and partitions, by count and by sums of both
    halves of the row hashes."""
    h = df.select(row_hash(columns).alias("h"))
    part = lambda a: F.sum(F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)"))
    return h.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(16).cast("string"), part(31).cast("string")), 256).alias("digest"))


def append(records: Iterable[dict], head: str = GENESIS) -> list[dict]:
    """Records with ``before_sha256`` and ``own_sha256``, each covering the one before. Sequential by nature."""
    out = []
    for r in records:
        body = json.dumps({**r, "before_sha256": head}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        head = hashlib.sha256(body.encode()).hexdigest()
        out.append(json.loads(body) | {"own_sha256": head})
    return out


def broken_links(ledger: DataFrame, order: str, segment: str | None = None) -> DataFrame:
    """Rows of a ledger table whose previous hash isn't the hash of the row before. A check of neighbours needs no fold;
    with ``segment``, an ordered bucket of rows such as a month, only first and last rows of segments meet in one task."""
    own = W.partitionBy(*([segment] if segment else [])).orderBy(order)
    before = F.lag("own_sha256").over(own)
    checked = ledger.withColumn("_before", before)
    if segment:
        ends = ledger.groupBy(segment).agg(F.max_by("own_sha256", order).alias("_last"))
        heads = ends.withColumn("_carry", F.lag("_last").over(W.orderBy(segment))).select(segment, "_carry")
        checked = checked.join(heads, segment).withColumn("_before", F.coalesce("_before", "_carry")).drop("_carry")
    return checked.where(~F.col("before_sha256").eqNullSafe(F.coalesce("_before", F.lit(GENESIS)))).drop("_before")


def commit(spark: SparkSession, folder: str, records: Iterable[dict]) -> str:
    """Appends records to the ledger in ``folder``, in whatever file system it lies: a new numbered file of JSON lines
    that continues the chain, written under another name and put in place in one step. Gives the new head."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    files = sorted(str(f.getPath().toString()) for f in fs.listStatus(path(folder)) if f.getPath().getName().endswith(".jsonl"))
    head = json.loads(spark.read.text(files[-1]).withColumn("place", F.monotonically_increasing_id()).agg(F.max_by("value", "place")).first()[0])["own_sha256"] if files else GENESIS
    if not (rows := append(records, head)):
        return head
    writing = f"{folder}/writing-{len(files):09d}"
    out = fs.create(path(writing), True)
    out.write(bytearray("".join(json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" for r in rows).encode()))
    out.close()
    if not fs.rename(path(writing), path(f"{folder}/{len(files):09d}.jsonl")):
        raise OSError(f"{writing} can't be put in place")
    return rows[-1]["own_sha256"]


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The ledger in ``folder``; an error where a record's own hash or its link to the one before doesn't hold. Files
    are checked as texts, so each record is hashed where it is read and only heads and ends of files meet."""
    lines = spark.read.text(f"{folder}/*.jsonl").select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"))
    link = lambda name: F.regexp_extract("value", rf'"{name}":"([0-9a-f]{{64}})"', 1)
    rows = lines.select("file", "place", "value", link("before_sha256").alias("before_sha256"), link("own_sha256").alias("own_sha256"), F.sha2(F.regexp_replace("value", r',"own_sha256":"[0-9a-f]{64}"', ""), 256).alias("hash"))
    bad = rows.where("hash != own_sha256").unionByName(broken_links(rows, "place", "file"))
    if found := bad.head(1):
        raise CheckFailed(f"{found[0].file}: the chain doesn't hold")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
