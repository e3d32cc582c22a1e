"""Words of whole texts as arrays: positions, 64-bit hashes and n-gram hashes of one Arrow batch.

A word is a longest run of bytes that are not blank (space and \\x09 to \\x0D). Texts are
handled in slices of about ``SLICE`` bytes, so memory does not follow the batch; one longer
text makes one longer slice. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text handled at a time
SLICE = 1 << 21


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _blank_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers (two multiply-shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of rows ``first`` to ``first + len(ptr) - 2`` of a batch; ``ptr[i]:ptr[i+1]`` are row i's words."""

    first: int
    data: np.ndarray      # bytes of the slice, as they are
    row_at: np.ndarray    # byte offset of each row in data, and the end
    ptr: np.ndarray
    start: np.ndarray     # byte offset of each word in data
    end: np.ndarray
    hash: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def ngrams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every n following words of a row and the number of their first words."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        row = self.row_of_word()
        at = np.flatnonzero(row[: len(h) - n + 1] == row[n - 1:])
        return window_hash(h, at, n), at


def window_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the n numbers from each place on."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[at + i]
    return mix(out)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets with the end) of slices of a string or binary column."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, raw[at[i]: at[j]], at[i: j + 1] - at[i]
        i = j


def words(column: pa.Array, lower: bool = True, limit: int = SLICE) -> Iterator[Words]:
    """Words of every row of a string column, slice by slice."""
    blank, low = _blank_table(), _lower_table()
    power = np.ones(1, np.uint64)
    for first, data, row_at in text_slices(column, limit):
        inside = ~blank[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = row_at[:-1][row_at[:-1] < row_at[1:]]
        ends = row_at[1:][row_at[:-1] < row_at[1:]]
        opens[filled] = inside[filled]
        closes[ends - 1] = inside[ends - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        ptr = np.searchsorted(start, row_at)
        if len(start):
            longest = int((end - start).max())
            if len(power) <= longest:
                power = np.cumprod(np.full(longest + 1, 0x5851F42D4C957F2D, np.uint64))
            body = slice(int(start[0]), None)
            place = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
            np.minimum(place, longest, out=place)
            letters = (low[data[body]] if lower else data[body]).astype(np.uint64)
            letters += np.uint64(1)
            letters *= inside[body]
            letters *= power[place]
            hashed = mix(np.add.reduceat(letters, start - start[0]))
        else:
            hashed = np.zeros(0, np.uint64)
        yield Words(first, data, row_at, ptr, start, end, hashed)
