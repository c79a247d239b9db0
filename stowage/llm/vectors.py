"""Vectors in Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the column, matrix in double precision) of the vectors of each length; those that are null, empty or hold null or non-finite components are in none."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()  # without what null lists may hide
    bad = np.asarray(pc.is_null(flat)) if flat.null_count else np.zeros(len(flat), bool)
    values = np.asarray(pc.fill_null(flat, 0.0) if flat.null_count else flat, np.float64)
    bad |= ~np.isfinite(values)
    begin = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        at = begin[rows][:, None] + np.arange(n)
        good = ~bad[at].any(1)
        if good.any():
            yield rows[good], values[at[good]]
