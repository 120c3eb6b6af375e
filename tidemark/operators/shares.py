"""Shares of a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def capped(rows: DataFrame, keys: Sequence[str], weight: str, order: Sequence[str], cap: float) -> DataFrame:
    """``rows`` with ``share``: parts of one by weight, of which none is above ``cap``, or above equal shares where the
    cap leaves no other way. What is cut off a part goes to those below the cap, by weight. In falling order the capped
    ones come first, and a part is capped if its share of what those before it leave is: so windows over sums do it,
    without filling round by round. Rows without a positive weight get nothing."""
    w = W.partitionBy(*keys)
    ranked = w.orderBy(F.desc(weight), *order)
    c, r = F.col("_c"), F.col("_r")
    placed = (
        rows.withColumn("_w", F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)))
        .withColumn("_c", F.greatest(F.lit(cap), 1.0 / F.count(F.lit(1)).over(w)))
        .withColumn("_r", F.row_number().over(ranked))
        .withColumn("_s", F.sum("_w").over(ranked.rowsBetween(W.currentRow, W.unboundedFollowing)))
    )
    counted = placed.withColumn("_j", F.count_if(F.col("_w") * (1 - c * (r - 1)) > c * F.col("_s") + 1e-9).over(w))
    rest = counted.withColumn("_rest", F.sum(F.when(r > F.col("_j"), F.col("_w"))).over(w))
    share = F.when(r <= F.col("_j"), c).otherwise(F.coalesce(F.col("_w") * (1 - c * F.col("_j")) / F.nullif(F.col("_rest"), F.lit(0)), F.lit(0.0)))
    return rest.withColumn("share", share).drop("_w", "_c", "_r", "_s", "_j", "_rest")
