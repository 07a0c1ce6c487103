"""Vectorised words, hashes and windows over Arrow string buffers.

Everything works on byte arrays of whole documents, a few megabytes at a time, so memory is
bounded by one slice (or by one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, *range(0x09, 0x0E))
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
SLICE_BYTES = 1_000_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 0x10001)) * U64(0x9E3779B97F4A7C15))


_FOLD = np.arange(256)
_FOLD[65:91] += 32
BYTE_CODES = [seeded(11, 256), seeded(29, 256)]
FOLDED_CODES = [codes[_FOLD] for codes in BYTE_CODES]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _POWERS.get(base, np.ones(1, U64))
    while len(held) < n:
        held = np.concatenate([held, held * U64(pow(base, len(held), 2**64))])
    _POWERS[base] = held
    return held[:n]


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null texts count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of True within each document, and each document's first run."""
    full = offsets[1:] > offsets[:-1]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first], ends[last] = inside[first], inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words [^ \\t-\\r]+ of each document: start bytes, end bytes, first word of each document."""
    return runs(~_SEP[data], offsets)


def span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte span."""
    base = _BASES[which]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * powers(base, len(data)), out=total[1:])
    inverse = powers(pow(base, -1, 2**64), len(data) + 1)
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64) * U64(0xA24BAED4963EE407))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words that begin a window of `size` words within their document."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return np.flatnonzero(left >= size)


def window_hash(hashes: np.ndarray, starts: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit hash of each window of `size` consecutive word hashes."""
    base = _BASES[which] ^ 0x5DEECE66C
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    inverse = powers(pow(base, -1, 2**64), len(hashes) + 1)
    return mix((total[starts + size] - total[starts]) * inverse[starts] + U64(size))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words that begins at one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step)[:n] > 0
