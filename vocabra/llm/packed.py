"""Sorted integers and counts as compact bytes, for blocks that one shuffle row carries."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers as planes of bytes, lowest first, no more planes than the largest needs; ``rising`` ones as their
    differences. Planes that are mostly zero shrink to little when Spark compresses its shuffle."""
    if not len(values):
        return b""
    x = values.astype("<u8")
    if rising:
        x = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data, rising: bool = False) -> np.ndarray:
    """The integers of pack(), as 64-bit unsigned ones."""
    if not len(data):
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, :width] = planes.T
    x = x.reshape(-1).view("<u8")
    return np.cumsum(x, dtype=np.uint64) if rising else x


def joined(fields: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in fields)


def fields(data) -> list:
    """The fields of joined(), as views of ``data``."""
    data, at, out = memoryview(data), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    start = np.flatnonzero(np.r_[True, new])
    return start, np.diff(np.r_[start, n])
