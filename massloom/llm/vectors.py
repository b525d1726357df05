"""Columns of vectors: which take part, and their integer components as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components are held within these bounds, so that sums of squares of 64 differences fit in 63 bits.
LARGEST = 1 << 27


def whole_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is neither null nor holds null, NaN or infinite components; vectors become array<double>."""
    own = table.withColumn(column, F.col(column).cast("array<double>"))
    return own.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def dimensions(table: DataFrame, column: str = "embedding") -> int:
    """The length of the longest vector."""
    return table.agg(F.max(F.size(column))).first()[0] or 0


def integers(column: pa.Array | pa.ChunkedArray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each component, one row a vector; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale)), -LARGEST, LARGEST).astype(np.int64)
    if (size == dims).all():
        return values.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exactly: in floats where every partial sum is an integer that they hold, else in int64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    for kind, bound in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if most < bound:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
