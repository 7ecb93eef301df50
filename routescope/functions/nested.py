"""NumPy views of nested Arrow list columns, for Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def walk(col: pa.Array | pa.ChunkedArray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Flatten ``depth`` list levels.

    Returns the leaf values, for each level the index of the leaf's ancestor in its parent (level 0 is the
    row number), and a mask of the leaves that are not null. Null or empty lists contribute no leaf.
    """
    arr = as_array(col)
    index = [np.arange(len(arr), dtype=np.int64)]
    for _ in range(depth):
        n = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parent = np.repeat(np.arange(len(arr), dtype=np.int64), n)
        at = np.arange(len(parent), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        index = [x[parent] for x in index] + [at]
        arr = as_array(arr.flatten())
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) else 0)
    return arr.to_numpy(zero_copy_only=False), index, valid


def beside(index: list[np.ndarray], other: list[np.ndarray], values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of another nested column at the same positions, and whether they are there and not null."""
    if all(len(a) == len(b) and np.array_equal(a, b) for a, b in zip(index, other, strict=True)):
        return values, ok
    span = [int(max(a.max(initial=0), b.max(initial=0))) + 1 for a, b in zip(index, other, strict=True)]
    mine, theirs = np.ravel_multi_index(index, span), np.ravel_multi_index(other, span)
    if not len(theirs):
        return np.zeros(len(mine), values.dtype), np.zeros(len(mine), bool)
    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
    there = theirs[at] == mine
    return np.where(there, values[at], 0), there & ok[at]
