"""Vectors as exact integers: shared by the operators that compare them in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Largest component and length whose products and squared differences surely fit 64 bits.
LARGEST, PRODUCTS = 2**30, 2**61


def whole(vector: Column) -> Column:
    """Whether a vector is there with every component present and finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """``vector`` (whole) replaced by ``floor(scale * x)`` of its components, little-endian 32-bit integers, and ``dim``, their number.

    Components that could take a sum of squares beyond 64 bits are refused with an error: no result of theirs would be right.
    """
    names = [c for c in vectors.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(vector)
            ends = np.diff(column.offsets.to_numpy()) if b.num_rows else np.empty(0, np.int64)
            with np.errstate(over="ignore"):
                x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            most = np.abs(x).max(initial=0)
            if most >= LARGEST or 4 * most * most * ends.max(initial=0) >= PRODUCTS:
                raise ValueError("a component is too large for whole results")
            at = np.r_[0, np.cumsum(ends)]
            x = x.astype("<i4")
            cells = pa.array([x[at[i]:at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), cells, pa.array(ends.astype(np.int32), pa.int32())], [*names, vector, "dim"])

    kinds = dict(vectors.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{vector}` binary", "dim int"])
    return vectors.select(*names, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)


def matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """Binary cells of ``dim`` integers as rows of 64-bit integers."""
    return np.frombuffer(b"".join(cells.to_pylist()), dtype="<i4").reshape(len(cells), dim).astype(np.int64)


def exact_type(dim: int, most: int, other: int) -> type:
    """The fastest number type in which the inner products of such rows are exact."""
    reach = dim * most * other
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
