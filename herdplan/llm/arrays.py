"""Whole columns of text as numpy byte arrays: words, hashes of words, windows.

Every function works on one *slice* of a column, a run of documents of bounded
size, so its temporary arrays are bounded too (a single longer document makes
a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, past the last, their bytes, their offsets), each slice
    of at most ``limit`` bytes or one document."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document of each) of the maximal runs of other bytes than
    separators; no word crosses documents."""
    if len(data) == 0:
        return (np.empty(0, np.int64),) * 3
    word = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def byte_table(seed: int, zero: np.ndarray = _SPACE) -> np.ndarray:
    """A random 64-bit number for each byte value; 0 for those of ``zero``."""
    t = stream(seed, 256)
    t[zero] = 0
    return t


def positions(starts: np.ndarray, n: int) -> np.ndarray:
    """For each byte its distance from the start at or before it."""
    out = np.arange(n, dtype=np.int64)
    if len(starts):
        lead = int(starts[0])
        out[lead:] -= np.repeat(starts, np.diff(np.append(starts, n)))
    return out


def powers(n: int, seed: int) -> np.ndarray:
    base = np.full(max(n, 1), stream(seed, 1)[0] | np.uint64(1), np.uint64)
    base[0] = 1
    return np.cumprod(base)


def hash_words(data: np.ndarray, starts: np.ndarray, table: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word; bytes that ``table`` maps to 0 do not count."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lead = int(starts[0])  # what stands before the first word may be longer than any word
    data, starts = data[lead:], starts - lead
    at = positions(starts, len(data))
    values = table[data] * powers(int(at.max()) + 1, seed)[at]
    return mix(np.add.reduceat(values, starts) + _GOLD)


def window_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """64-bit hash of every k consecutive entries (len(h) - k + 1 of them).

    Windows of doubled width are combined, each time through the mixer, so the
    order of the entries counts and nothing is linear in them.
    """
    if len(h) < k:
        return np.empty(0, np.uint64)
    a, b = stream(seed, 2) | np.uint64(1)
    join = lambda x, y: mix(x * a + (y ^ (y >> np.uint64(29))) * b)
    n, out, part, width, done = len(h) - k + 1, None, h, 1, 0
    while True:
        if k >> (width.bit_length() - 1) & 1:
            piece = part[done : done + n]
            out = mix(piece + a) if out is None else join(out, piece)
            done += width
        if width * 2 > k:
            return out
        part = join(part[:-width], part[width:])
        width *= 2


def run_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by owner (0 to n - 1), in double precision."""
    return np.bincount(owner, weights=values, minlength=n)[:n]
