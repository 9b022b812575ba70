"""Vectors as rows of whole numbers: which take part, and exact sums of products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector that is there and whose components all are finite numbers; true for one without components."""
    inside = lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf"))  # noqa: E731  Spark sorts NaN above infinity
    return F.col(vector).isNotNull() & F.forall(vector, inside)


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, as longs; a component that gives no long is an error."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")).cast("long"))

    return F.transform(vector, whole)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as rows of ``width`` numbers, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - offsets[row]] = values
    return out


def largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact; OverflowError where one is beyond 64 bits."""
    most = a.shape[1] * largest(a) * largest(b)
    if most < 2**53:  # doubles hold each partial sum exactly
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)
