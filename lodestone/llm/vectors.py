"""Vectors in Arrow batches, fast Hadamard rotations and cross-polytope symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null or empty, holds only finite numbers, and is not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, seed: int, to: int) -> np.ndarray:
    """Rows padded with zeros to `to` numbers and turned by three rounds of random signs and a Hadamard transform."""
    signs = np.random.default_rng([seed, to]).choice([-1.0, 1.0], size=(3, to))
    out = np.zeros((len(x), to))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def symbols(y: np.ndarray, count: int = 1) -> np.ndarray:
    """The `count` nearest vertices of the cross-polytope for each row: twice a coordinate plus its sign."""
    size = np.abs(y)
    at = size.argmax(1)[:, None] if count == 1 else np.argsort(-size, axis=1, kind="stable")[:, :count]
    return at * 2 + (np.take_along_axis(y, at, 1) > 0)


def of_one_size(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds `dim`, the vector's length: Arrow batches may mix lengths, so operators treat each by itself."""
    return df.withColumn("dim", F.size(column))
