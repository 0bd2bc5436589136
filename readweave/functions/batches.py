"""Columns of text as one flat byte array, cut into windows of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 2 << 20


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at - at[0]


def windows(column: pa.Array, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer text is a window of its own, whole."""
    buf, at = flat_text(column)
    rows, lo = len(at) - 1, 0
    while lo < rows:
        hi = max(lo + 1, min(int(np.searchsorted(at, at[lo] + size, "right")) - 1, lo + 20_000, rows))
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + length[i] - 1 of all i, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)
