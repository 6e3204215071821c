"""Vectors as integers: what the operators on integer components share."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def finite(vector: str) -> Column:
    """Neither NULL nor with a NULL or non-finite component."""

    def plain(c: Column) -> Column:
        d = c.cast("double")
        return c.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(math.inf))

    return F.coalesce(F.forall(F.col(vector), plain), F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """``floor(scale * component)`` as 64-bit integers; beyond, the nearest bound."""
    return F.transform(
        F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    )


def rows_by_size(batch: pa.RecordBatch, name: str):
    """``(length, row numbers, rows as a matrix)`` of a column of integer lists."""
    column = batch.column(name)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield size, at, values.reshape(len(at), size)
