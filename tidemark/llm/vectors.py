"""Vector columns as integers: floor(factor * x) of each component, for operators whose arithmetic is exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.filter(F.col(column).isNotNull() & ~bad)


def shape(df: DataFrame, column: str, factor: int) -> tuple[int, int, int]:
    """Rows, components of the longest vector, and the largest size of an integer, of kept rows: one row on the driver."""
    size = F.array_max(F.transform(column, lambda x: F.abs(x.cast("double"))))
    found = df.agg(F.count("*").alias("rows"), F.max(F.size(column)).alias("width"), F.max(size).alias("size")).first()
    return found.rows, found.width or 0, int((found.size or 0.0) * factor) + 1


def integers(column: pa.Array, width: int, factor: int) -> np.ndarray:
    """One row of ``width`` integers (as exact floats) for each vector; shorter vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out
