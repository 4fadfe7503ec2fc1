"""Words of many texts at once, as numpy arrays over the UTF-8 bytes that Arrow hands to a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240501)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that separate words (space, tab to carriage return), and A-Z made lower case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `limit` bytes; a longer text stands alone. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of the runs of True in `letters`; none reaches over the start of a row."""
    n = len(letters)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], letters[:-1]))
    starts = np.flatnonzero(letters & (~before | first[:-1]))
    after = np.concatenate((letters[1:], [False]))
    ends = np.flatnonzero(letters & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Hashes:
    """64-bit hashes of any spans of some bytes, from sums of powers over all of them."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `width` lower-cased words of each row; of all its words where it has fewer. Not yet distinct."""
    starts, ends, row = spans(~SPACE[data], offsets)
    h = Hashes(LOWER[data]).of(starts, ends)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    counts = np.diff(bounds)
    # a short row's words are one sequence: pad it to the full width, marked by its number of words
    out_row, out = [], []
    if len(h) >= width:
        run = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        whole = row[: len(run)] == row[width - 1 :]
        out_row.append(row[: len(run)][whole])
        out.append(run[whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        run = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = k < counts[short]
            nxt = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(bounds[short] + k, len(h) - 1)])
            run = np.where(there, nxt, run)
        out_row.append(short)
        out.append(mix(run + counts[short].astype(np.uint64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, hashes = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return rows[order], hashes[order]
