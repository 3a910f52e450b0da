"""Words of many texts at once: numpy over the UTF-8 buffer of an Arrow batch, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; the arrays beside them take some 40 times as much.
CHUNK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """At the end of a task: a Python worker lives on for the next one, and gives back what it no longer uses."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as [^\x20\x09-\x0D]+.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = False
#: Words as runs of ASCII letters and digits and of every byte of a longer code point: punctuation doesn't count.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n, _BASE_INVERSE, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in those bytes and their end), whole texts only. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of a chunk: start and end (bytes), row, hash, and the first word of each row (with the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_BLANK):
        low = LOWER[data]
        inside = keep[data]
        starts = inside.copy()
        ends = inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
            starts[firsts] = inside[firsts]
            lasts = firsts[1:] - 1
            ends[lasts] = inside[lasts]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        size = max(CHUNK, 1 << int(max(1, len(data))).bit_length()) if len(data) > CHUNK else CHUNK
        up, down = _powers(size)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum((low.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start] if len(self.start) else np.zeros(0, U64)
        self.hash = mix(raw + (self.end - self.start).astype(U64))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words of a row; a row with fewer words, but one, has its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.first)
    if n >= k:
        out = np.zeros(n - k + 1, U64)
        for i in range(k):
            out = mix(out + h[i : n - k + 1 + i])
        inside = words.row[: n - k + 1] == words.row[k - 1 :]
        out, row = out[inside], words.row[: n - k + 1][inside]
    else:
        out, row = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        alone = []
        for r in short:
            x = np.full(1, int(counts[r]) * _BASE % (1 << 64), U64)
            for i in range(words.first[r], words.first[r + 1]):
                x = mix(x + h[i : i + 1])
            alone.append(x[0])
        out = np.concatenate([out, np.array(alone, U64)])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row
