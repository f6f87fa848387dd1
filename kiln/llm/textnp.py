"""Vectorised helpers over the raw UTF-8 of Arrow text columns.

All functions work on a slice of a batch (``slices``), so the numpy temporaries stay bounded by
the slice size and the longest single text, whatever the batch or partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are separated by these bytes: 0x20 and 0x09-0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd base of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

SLICE_BYTES = 2 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each (kept per process)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that hashes of close inputs are unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(offsets) < 2:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many words each row has."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a word cannot go on from the byte before
    cut[1:] = space
    cut[offsets] = True
    starts = np.flatnonzero(~space & cut[:-1])
    cut[:-1] = space
    cut[offsets] = True
    ends = np.flatnonzero(~space & cut[1:]) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ascending, disjoint, non-empty byte spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    spans = (total[ends] - total[starts]) * inverse[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row of each item, from the number of items of each row."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def shingles(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of ``size`` words; a row with fewer words has all of them as
    one shingle, a row without words has none."""
    rows = row_of(counts)
    n = len(words)
    out, of = [], []
    if n >= size:
        full = rows[:n - size + 1] == rows[size - 1:]
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            h = mix(h * np.uint64(3) + words[k:n - size + 1 + k] * np.uint64(_STEP[k % 5]))
        out.append(h[full])
        of.append(rows[:n - size + 1][full])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts)[short] - counts[short]
        h = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            h[has] = mix(h[has] * np.uint64(5) + words[first[has] + k] * np.uint64(_STEP[k % 5]))
        out.append(mix(h + counts[short].astype(np.uint64)))
        of.append(short)
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h, of = np.concatenate(out), np.concatenate(of)
    if len(short):
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of


def distinct_by_row(h: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending within it, and how many each row has."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), counts
