"""Texts of an Arrow batch as one byte array, and hashed byte trigrams over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BUCKETS = 1 << 14
#: Letters lower-cased, other ASCII bytes a space, bytes of other characters kept.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, n + 1 offsets into them) for runs of rows of about `most` bytes or one long row."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, and which of them count: those within
    a row whose middle is not a space."""
    x = FOLD[data].astype(np.int32)
    if len(x) < 3:
        return np.zeros(len(x), np.int32), np.zeros(len(x), bool)
    h = np.zeros(len(x), np.int32)
    h[:-2] = ((x[:-2] * 31 + x[1:-1]) * 97 + x[2:]) & (BUCKETS - 1)
    ok = np.zeros(len(x), bool)
    ok[:-2] = x[1:-1] != 32
    for k in (1, 2):
        last = offsets[1:] - k
        ok[last[(last >= 0) & (last >= offsets[:-1])]] = False
    return h, ok


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values over each row; 0 for empty rows."""
    total = np.append(0, np.cumsum(values))
    return total[offsets[1:]] - total[offsets[:-1]]
