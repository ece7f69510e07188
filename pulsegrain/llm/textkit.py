"""Whole-column text kernels on the raw bytes of Arrow string columns.

A column of texts is one flat byte array plus document offsets.  Everything here is a handful of
numpy passes over those bytes, cut into blocks of about one megabyte so that memory does not depend
on the batch.  Null texts are read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = _class((0x20, 0x20), (0x09, 0x0D))
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words of text whose A-Z are lower-cased.
NON_WORD = _class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Maps A-Z to a-z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_PLACE = stream(2, 1 << 16) | np.uint64(1)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and int64 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; a longer text is a run alone."""
    data, offsets = arrow_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators, which never cross a row, and each row's first run."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ordered byte ranges, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    shift = np.repeat(starts - before, lengths)
    at = np.arange(len(shift)) + shift
    place = at - np.repeat(starts, lengths)
    values = _BYTE[data[at]]
    if int(lengths.max()) > len(_PLACE):
        values += (place >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place &= len(_PLACE) - 1
    values *= _PLACE[place]
    return mix(np.add.reduceat(values, before) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window and the index of its first word; rows shorter than n words have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for k, factor in enumerate(stream(3, n) | np.uint64(1)):
        total += mix(words[k : k + count] + np.uint64(k)) * factor
    fits = np.ones(count, dtype=bool)
    for k in range(1, n):  # a window must not begin within the last n - 1 words of a row
        bad = firsts[1:] - k
        bad = bad[(bad >= 0) & (bad < count) & (bad >= firsts[:-1])]
        fits[bad] = False
    at = np.flatnonzero(fits)
    return mix(total[at]), at


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
