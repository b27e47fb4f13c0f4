"""Vectors of an Arrow column as arrays, and how pairs of blocks of vectors meet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows whose vectors hold finite numbers only, and these as doubles, filled with zeros up to
    the longest (or width). Null vectors and those with null, NaN or infinite components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, width or 0))
    values = column.flatten()
    length = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(length)), length)
    good[owner[~np.isfinite(flat)]] = False
    rows = np.flatnonzero(good)
    width = width or int(length.max(initial=0))
    out = np.zeros((len(length), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    keep = place < width
    out[owner[keep], place[keep]] = flat[keep]
    return rows, out[rows]


def packed(values: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(values, "<f8")]


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)
