"""Ragged numpy arrays as Arrow arrays and back, without a Python object for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def ragged_index(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs ``starts[i] .. starts[i] + counts[i]``, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes: ``data`` is uint8, ``offsets`` has n + 1 entries."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def list_array(values: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Rows of int32; where ``valid`` is False the row is null."""
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)), mask=mask)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 data, n + 1 offsets) of a string or binary column; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
