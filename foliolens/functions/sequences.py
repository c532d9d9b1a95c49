"""Functions of ordered values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_nondecreasing(values: Column) -> Column:
    """Length of the longest non-decreasing subsequence: a fold whose state is the smallest ends by length."""
    tails = F.aggregate(
        values, F.expr("cast(array() as array<bigint>)"),
        lambda t, x: F.concat(F.filter(t, lambda y: y <= x), F.array(x.cast("bigint")), F.slice(F.filter(t, lambda y: y > x), 2, F.size(t) + 1)))
    return F.size(tails)
