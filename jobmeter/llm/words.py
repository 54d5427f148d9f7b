"""Whole-batch splitting and hashing of words and lines in UTF-8 bytes.

An Arrow text column is one buffer of bytes plus row bounds. Everything here works on such buffers
with numpy, without a Python object per word. White space is ``[\\x20\\x09-\\x0D]`` throughout; these
are single bytes in UTF-8, so that bytes can be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # arrays of this many rows of eight bytes stay near the processor's caches

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = np.arange(256)
_LOWER = np.arange(256)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55  # odd, hence invertible modulo 2**64
_powers = {1: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent scrambling for every seed."""
    return mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64))


_BYTE_VALUES = [seeded(np.arange(256, dtype=np.uint64), 1000 + k) for k in range(2)]


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Spans:
    """Words or lines of a slice: byte bounds, the row each lies in, and a hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds within these bytes) for runs of rows of about ``limit`` bytes.

    Null counts as empty. A row longer than the limit is a slice of its own and stays whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def span_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, which: int = 0
) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes hash alike wherever they stand."""
    values = _BYTE_VALUES[which][_LOWER if lower else _EXACT][data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(data)), out=total[1:])
    inverse = _power(pow(_BASE, -1, 2**64), len(data) + 1)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Spans:
    """Maximal runs of other bytes than white space, row by row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[bounds] = False
    start = np.flatnonzero(inside & ~before)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside[:-1]
    after = inside.copy()
    after[bounds] = False
    end = np.flatnonzero(stops & ~after)
    row = np.searchsorted(bounds, start, "right") - 1
    return Spans(start, end, row, span_hashes(data, start, end, lower))


def lines(data: np.ndarray, bounds: np.ndarray) -> Spans:
    """The parts between line feeds, row by row; a row without one is a single line."""
    feeds = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, feeds, "right") - 1])
    start = np.concatenate([bounds[:-1], feeds + 1])
    end = np.concatenate([feeds, bounds[1:]])
    order = np.lexsort((start, row))
    # Ends pair with starts in the same order: in each row the last end is the row's own.
    end_row = np.concatenate([np.searchsorted(bounds, feeds, "right") - 1, np.arange(len(bounds) - 1)])
    end = end[np.lexsort((end, end_row))]
    return Spans(start[order], end, row[order], np.zeros(0, np.uint64))


def strip(data: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bounds without white space at both ends; empty spans for white space alone."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return spans.start, spans.start.copy()
    first = np.searchsorted(solid, spans.start)
    last = np.searchsorted(solid, spans.end) - 1
    some = first <= last
    start = np.where(some, solid[np.minimum(first, len(solid) - 1)], spans.start)
    end = np.where(some, solid[np.maximum(last, 0)] + 1, spans.start)
    return start, end


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of code points of each span."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total[end] - total[start]


def shingles(spans: Spans, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``size`` words, sorted; short rows give one whole run."""
    weight = _power(0x8CB92BA72F3D8DD7, size + 1)
    n = len(spans.hash)
    counts = np.bincount(spans.row, minlength=rows)
    row, value = [], []
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += spans.hash[k : n - size + 1 + k] * weight[k]
        whole = spans.row[: n - size + 1] == spans.row[size - 1 :]
        row.append(spans.row[: n - size + 1][whole])
        value.append(mix(total[whole]))
    short = (counts > 0) & (counts < size)
    if short.any():
        first = np.zeros(rows + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        total = np.zeros(rows, np.uint64)
        for k in range(size - 1):
            has = short & (counts > k)
            total[has] += spans.hash[first[:-1][has] + k] * weight[k]
        total += counts.astype(np.uint64) * weight[size]
        row.append(np.flatnonzero(short))
        value.append(mix(total[short]))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]
