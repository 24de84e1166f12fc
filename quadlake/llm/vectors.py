"""Vectors as whole numbers: which rows take part, and matrices of a batch.

A vector takes part when neither it nor any component is null or not finite. Component x
becomes floor(scale * x). Shorter vectors are filled up with zeros to the width of the
longest one, so ragged tables have a defined result and lose no row. Components beyond
2 ** 23 after scaling raise an error: sums of 128 products then stay exact in doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1 << 23
# Products of whole numbers up to this size stay exact in doubles for 2 ** 13 of them.
EXACT = 1 << 20


def is_whole(vector: Column) -> Column:
    """The vector and all its components are there and finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def extent(df: DataFrame, vector: str, scale: int) -> tuple[int, str]:
    """Components of the longest vector, and the type of whole numbers that all scaled components fit."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    longest, largest = df.agg(F.max(F.size(vector)), F.max(most)).first()
    if (largest or 0) * scale >= MOST:
        raise ValueError(f"components beyond {MOST} after scaling")
    return longest or 0, "<i2" if (largest or 0) * scale < 32767 else "<i4"


def scaled(column: pa.Array, n: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a batch, as rows of n whole numbers."""
    out = np.zeros((len(column), n), np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    if not rows.shape[1]:
        return pa.array([b""] * len(rows), pa.binary())
    fixed = pa.binary(rows.itemsize * rows.shape[1])
    return pa.FixedSizeBinaryArray.from_buffers(fixed, len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def unpacked(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    """The matrix behind rows of bytes."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), n)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and of b, exact."""
    if not a.size or not b.size or (np.abs(a).max() <= EXACT and np.abs(b).max() <= EXACT):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
