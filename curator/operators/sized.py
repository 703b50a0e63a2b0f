"""Broadcasts behind a check of size, and running sums without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, bucket: Column, name: str) -> DataFrame:
    """``df`` with the running sum ``name`` of ``value`` before each row, in two levels.

    ``bucket`` must not decrease along ``order``. Only buckets' totals, one row each, are summed in one place per key; rows
    are summed within their bucket, so no task holds all rows of a key.
    """
    d = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = d.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(starts, [*keys, "_bucket"])
    return out.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_bucket", "_value", "_start", "_within")
