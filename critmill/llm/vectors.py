"""Vectors in tasks: rows of Arrow lists as integer matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are 64-bit integers after scaling, with room for a sign and a difference.
MOST = 1 << 62


def plain(vector: Column) -> Column:
    """A column of vectors as doubles, for `integer_rows`."""
    return vector.cast("array<double>")


def integer_rows(column: pa.Array, scale: int, dims: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix (64-bit) of floor(scale * x), one pair for each length of vectors (only `dims`, if given).

    Rows that are null, empty, hold a null or non-finite component, or one that gives no 64-bit integer are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0))
    for d in [dims] if dims else np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(x * scale)
            good = (np.abs(v) < MOST).all(axis=1)  # false for NaN and infinity
        if good.any():
            yield rows[good], v[good].astype(np.int64)
