"""Vectorised scans of the UTF-8 bytes of many texts at once: runs, their 64-bit hashes, and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are scanned in groups of about so many bytes; a longer text is scanned in pieces cut at white space.
GROUP = 1 << 20
SHINGLE = 5

_R = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers.get("r", ())) < n:
        size, inverse = max(n, GROUP + 1), pow(_R, -1, 1 << 64)
        for name, base in (("r", _R), ("i", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["r"], _powers["i"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each run; not of where it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    r, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * r[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(past, n)
        first = min(past, n)


def words(data: np.ndarray, offsets: np.ndarray, first: int, past: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of rows first to past, and the number of words before each row and at the end."""
    low, high = int(offsets[first]), int(offsets[past])
    if past == first + 1 and high - low > 4 * GROUP:
        parts = [words(data, np.array(piece), 0, 1)[0] for piece in pieces(data, low, high)]
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    view = _LOWER[data[low:high]]
    space = _SPACE[view]
    bounds = offsets[first : past + 1] - low
    before = np.ones(len(view) + 1, bool)
    before[1:] = space
    before[bounds] = True  # a row begins where the last one ends, with no space between
    starts = np.flatnonzero(before[:-1] & ~space)
    after = np.ones(len(view) + 1, bool)
    after[:-1] = space
    after[bounds] = True
    ends = np.flatnonzero(after[1:] & ~space) + 1
    return run_hashes(view, starts, ends), np.searchsorted(starts, bounds)


def pieces(data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges of about GROUP bytes that begin with a run of white space, never inside one."""
    while low < high:
        past = min(low + GROUP, high)
        while past < high and not (_SPACE[data[past]] and not _SPACE[data[past - 1]]):
            white = _SPACE[data[past - 1 : past + GROUP]]
            step = np.flatnonzero(white[1:] & ~white[:-1])
            past = past + int(step[0]) if len(step) else min(past + GROUP, high)
        yield low, past
        low = past


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: runs of size words, or all its words if there are fewer."""
    data, offsets = buffers(column)
    salts = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for first, past in groups(offsets):
        hashes, bounds = words(data, offsets, first, past)
        rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for j in range(size):
            rolled += hashes[j : j + len(rolled)] * salts[j]
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                yield mixed((hashes[a:b] * salts[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
