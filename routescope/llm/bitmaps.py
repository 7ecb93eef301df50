"""Compressed sets of 16-bit record numbers: sorted array, run list or bit field, whichever is smallest."""

from __future__ import annotations

import numpy as np

ARRAY, RUNS, BITS = 0, 1, 2
BITS_BYTES = 8192


def encode(low: np.ndarray) -> bytes:
    """low: distinct uint16 values in ascending order."""
    low = low.astype(np.uint16, copy=False)
    n = len(low)
    cuts = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) if n > 1 else np.empty(0, np.int64)
    if n and 4 * (len(cuts) + 1) < min(2 * n, BITS_BYTES):
        first = low[np.concatenate(([0], cuts + 1))]
        last = low[np.concatenate((cuts, [n - 1]))]
        return bytes([RUNS]) + np.stack([first, last], axis=1).astype("<u2").tobytes()
    if 2 * n <= BITS_BYTES:
        return bytes([ARRAY]) + low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return bytes([BITS]) + np.packbits(bits).tobytes()


def decode(raw: bytes) -> np.ndarray:
    kind, body = raw[0], raw[1:]
    if kind == ARRAY:
        return np.frombuffer(body, "<u2")
    if kind == RUNS:
        ends = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        return np.concatenate([np.arange(a, b + 1) for a, b in ends]).astype(np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8))).astype(np.uint16)


def union(parts: list[bytes]) -> bytes:
    if len(parts) == 1:
        return parts[0]
    if any(p[0] == BITS for p in parts):
        bits = np.zeros(65536, np.uint8)
        for p in parts:
            bits[decode(p)] = 1
        return encode(np.flatnonzero(bits))
    return encode(np.unique(np.concatenate([decode(p) for p in parts])))


def cardinality(raw: bytes) -> int:
    kind, body = raw[0], raw[1:]
    if kind == ARRAY:
        return len(body) // 2
    if kind == RUNS:
        ends = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        return int((ends[:, 1] - ends[:, 0] + 1).sum())
    return int(np.unpackbits(np.frombuffer(body, np.uint8)).sum())
