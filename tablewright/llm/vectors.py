"""Arrow columns of number lists as matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of an entry, so that its long is exact as a double too.
LARGEST = 2.0 ** 40


def usable(vector: str) -> Column:
    """Whether a vector is there, and all of its entries are finite numbers."""
    return F.expr(f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> "
                  f"x is not null and abs(cast(x as double)) < {LARGEST!r}D)")


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most usable vectors have (of several, the smallest);
    0 without any. One row per length is shuffled, one reaches the driver."""
    found = (df.where(usable(vector)).groupBy(F.size(vector).alias("length")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "length").first())
    return int(found["length"]) if found else 0


def as_doubles(vector: str) -> Column:
    return F.col(f"`{vector}`").cast("array<double>")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, of lists of ``dim`` numbers, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim or 1, dtype=np.int32)[:n + 1]),
                                    pa.array(np.ascontiguousarray(rows).ravel(), kind))
