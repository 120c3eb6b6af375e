"""What changed between full snapshots, by content-defined chunks.

Rows of a snapshot are sorted by key within hash ranges of the key and cut into chunks wherever the key's own hash
says so; an insertion therefore moves no cut but its own. Chunks with equal digests in two successive snapshots hold
the same rows and are discarded; only rows of the other chunks are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut


def current_rows(df: DataFrame, snapshot: str, key: str, loaded: str, fields: dict[str, Column]) -> DataFrame:
    """One row per (snapshot, key), that of the latest load; a null load time is the oldest. Loads of the same time
    are told apart by their compared values, the greatest wins, so the result doesn't depend on the order of rows.
    Rows without a snapshot or key are no record."""
    names = list(fields)
    rows = df.select(F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.col(loaded).alias("loaded"), *[c.alias(f"f_{n}") for n, c in fields.items()]).where("snapshot is not null and key is not null")
    best = rows.groupBy("snapshot", "key").agg(F.max(F.struct("loaded", *[f"f_{n}" for n in names])).alias("r"))
    return best.select("snapshot", "key", *[F.col(f"r.f_{n}").alias(f"f_{n}") for n in names])


def chunked(rows: DataFrame, fields: Sequence[str], ranges: int, chunk_rows: int) -> DataFrame:
    """Adds ``range`` and ``chunk`` (the cutting key at or before the row's key, null before the first cut) and
    ``row_hash`` to current rows."""
    here = W.partitionBy("snapshot", "range").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
        .withColumn("chunk", F.last(F.when(F.pmod(F.xxhash64("key", F.lit("cut")), F.lit(chunk_rows)) == 0, F.col("key")), ignorenulls=True).over(here))
        .withColumn("row_hash", F.md5(F.to_json(F.struct("key", *[f"f_{n}" for n in fields]), {"ignoreNullFields": "false"})))
    )


def snapshot_changes(
    df: DataFrame,
    *,
    snapshot: str,
    key: str,
    loaded: str,
    fields: dict[str, Column],
    chunk_rows: int = 4,
    ranges: int | None = None,
) -> DataFrame:
    """``snapshot, key, change_kind, changed_fields`` for every record that was added, removed or changed against the
    preceding delivered snapshot, ``snapshot`` being the later one. ``fields`` names the compared expressions; null is
    a value. Repeated rows count once. A snapshot number that was never delivered is passed over. With fewer than two
    snapshots there are no changes. Clashing names of other columns don't matter. A chunk of n rows is discarded with
    probability (1 - c)^n where a share c of the rows changes, so ``chunk_rows`` should be about the inverse of the share
    expected; the default suits a tenth."""
    spark, names = df.sparkSession, list(fields)
    ranges = ranges or max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(chunked(current_rows(df, snapshot, key, loaded, fields), names, ranges, chunk_rows))
    # one row a delivery, so small enough to sort in one task and to broadcast
    order = W.orderBy("snapshot")
    following = rows.select("snapshot").distinct().select("snapshot", F.lead("snapshot").over(order).alias("next"), F.lag("snapshot").over(order).isNull().alias("is_first"))
    # a digest of the set of row hashes: their count, and sum and xor of both halves
    half = lambda a: F.conv(F.substring("row_hash", a, 15), 16, 10).cast("long")
    digests = rows.groupBy("snapshot", "range", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(half(1)).alias("x1"), F.bit_xor(half(17)).alias("x2"), F.sum(half(1).cast("decimal(38,0)")).alias("s1"), F.sum(half(17).cast("decimal(38,0)")).alias("s2")
    )
    pairs = F.explode(F.array(F.struct(F.when(~F.col("is_first"), F.col("snapshot")).alias("later"), F.lit(True).alias("is_new")), F.struct(F.col("next").alias("later"), F.lit(False).alias("is_new"))))
    sides = digests.join(F.broadcast(following), "snapshot").select("range", "chunk", "n", "x1", "x2", "s1", "s2", "snapshot", pairs.alias("p")).where("p.later is not null")
    differing = (
        sides.groupBy(F.col("p.later").alias("later"), "range", "chunk", "n", "x1", "x2", "s1", "s2")
        .agg(F.count(F.lit(1)).alias("sides"), F.max("snapshot").alias("snapshot"), F.max("p.is_new").alias("is_new"))
        .where("sides = 1")
        .select("later", "snapshot", "is_new", "range", "chunk")
    )
    unmatched = (
        rows.alias("r").join(differing.alias("d"), (F.col("r.snapshot") == F.col("d.snapshot")) & (F.col("r.range") == F.col("d.range")) & F.col("r.chunk").eqNullSafe(F.col("d.chunk")))
        .select("d.later", "d.is_new", "r.key", "r.row_hash", *[f"r.f_{n}" for n in names])
    )
    side = lambda new, tag: unmatched.where(F.col("is_new") == new).select("later", "key", *[F.col(c).alias(f"{tag}_{c}") for c in ("row_hash", *[f"f_{n}" for n in names])])
    both = side(False, "a").join(side(True, "b"), ["later", "key"], "full_outer")
    kind = F.when(F.col("a_row_hash").isNull(), "added").when(F.col("b_row_hash").isNull(), "removed").when(F.col("a_row_hash") != F.col("b_row_hash"), "changed")
    moved = F.when(kind == "changed", F.filter(F.array(*[F.when(~F.col(f"a_f_{n}").eqNullSafe(F.col(f"b_f_{n}")), F.lit(n)) for n in names]), lambda x: x.isNotNull()))
    return both.select(F.col("later").alias("snapshot"), "key", kind.alias("change_kind"), moved.alias("changed_fields")).where("change_kind is not null")
