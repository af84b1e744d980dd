"""Vectorised scanning of Arrow text columns: words, lines, hashes and windows as NumPy arrays.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``. All functions see
whole texts; a batch is only cut between rows, so memory follows the slice size and the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_WINDOW = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose texts come to about ``size`` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins. Null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Spans:
    """Segments of a slice: byte bounds, the row of each, and the first segment of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    ink = ~SPACE[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = ink[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = ink[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Spans(start, end, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets))


def line_spans(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines as ``text.split("\\n")`` gives them: every row has one at least, empty ones count."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a row's own beginning sorts before a line that begins at the same byte only in an earlier row
    row = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    end = np.append(start[1:], len(data))
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, offsets[row + 1] if len(row) else 0, end - 1)
    return Spans(start, end, row, np.searchsorted(row, np.arange(len(offsets))))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's bytes: a polynomial read off prefix sums modulo 2**64."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _P, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power("down", _PINV, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one row, and the index of each run's first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out += h[at + j] * _WINDOW[j]
    return mix(out), at


def repeated(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more in their row, and which equal an earlier one of their row."""
    key = h ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``offsets``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
