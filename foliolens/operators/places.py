"""Global places by an integer key without a task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one stretch; the sums over stretches are all that one task orders.
STRETCH = 65_536


def with_places(df: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """Add ``place``: the number of rows (or the sum of ``size``) before each row in the order of a unique integer key.

    Places are counted inside stretches of the key, and each stretch begins after the
    total of those before it.
    """
    n = F.col(size).cast("bigint") if size else F.lit(1).cast("bigint")
    rows = df.withColumn("_stretch", F.floor(F.col(key) / STRETCH))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_stretch").agg(F.sum(n).alias("_n")).select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_stretch").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, "_stretch")
    return placed.withColumn("place", F.col("_start") + F.col("_inside")).drop("_stretch", "_inside", "_start")
