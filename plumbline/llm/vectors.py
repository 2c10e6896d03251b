"""What operators over vectors share: which rows take part, and Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is there, and so are all its components, as finite numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The length that most vectors have (of equal numbers the larger length); None without rows."""
    n = F.count(F.lit(1)).alias("n")
    most = rows.groupBy(F.size(vector).alias("dims")).agg(n).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    return most[0].dims if most else None


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, all of ``dims`` components, as doubles."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), dims)


def scaled(x: np.ndarray, limit: int) -> np.ndarray:
    """floor(1024 * x) as integers, at most ``limit`` on either side of zero."""
    return np.clip(np.floor(1024 * x), -limit, limit).astype(np.int64)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
