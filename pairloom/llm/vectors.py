"""Columns of vectors as matrices of whole numbers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_vectors(column: pa.Array, scale: int, largest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector the places in the column and floor(scale * x) of their components.

    Null vectors, vectors with a null or non-finite component and those with a whole number over
    ``largest`` are left out.
    """
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    ends = np.asarray(column.offsets)[1:]
    entries = column.values.to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == dims)
        x = entries[(ends[at] - dims)[:, None] + np.arange(dims)].astype(np.float64)
        with np.errstate(invalid="ignore", over="ignore"):
            q = np.floor(scale * x)
            usable = (np.abs(q) <= largest).all(axis=1)
        yield at[usable], q[usable].astype(np.int64)
