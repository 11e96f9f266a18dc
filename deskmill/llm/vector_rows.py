"""Reading vectors out of rows and back, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vector: str):
    """Column: whether a vector is there, has components, all of them finite numbers, and isn't zero."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(frame: DataFrame, vector: str) -> int | None:
    """The most frequent length (the smaller of equals); None without rows."""
    row = frame.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else None


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[:n + 1]),
                                    pa.array(np.ascontiguousarray(rows).reshape(-1)))
