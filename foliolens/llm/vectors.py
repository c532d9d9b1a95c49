"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(embedding: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold finite components only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id bigint, embedding) of the rows that take part; a null id takes none."""
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding")).where(
        F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, in their own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
