"""Vectorised words and shingles of whole texts, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 20
ROWS = 2048
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.array([0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]))
    return _powers["up"][:n], _powers["down"][:n]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `size` bytes; a null text is empty."""
    for base in range(0, len(texts), ROWS):  # copies are made of so many rows at a time
        part = texts.slice(base, ROWS).fill_null("").cast(pa.large_binary())
        bufs = part.buffers()
        off = np.frombuffer(bufs[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
            hi = min(hi, len(part))
            yield base + lo, base + hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def forget_powers() -> None:
    """Give back the tables of powers."""
    _powers.clear()


def word_spans(
    data: np.ndarray, off: np.ndarray, separators: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word (A-Z as a-z, cut at separators) and, by row, the number of its first word."""
    n = len(data)
    space = separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    first, last = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    before[first], after[last] = True, True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start]), np.searchsorted(start, off)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its shingles of five words) of each row.

    A text with fewer words has its whole sequence as one shingle; without words the set is empty.
    """
    for lo, hi, data, off in chunks(texts):
        _, _, w, at = word_spans(data, off)
        m = len(w)
        sh = np.zeros(max(0, m - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            sh += w[j : j + len(sh)] * _PLACE[j]
        sh = mix(sh)
        for r in range(hi - lo):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= SHINGLE:
                u = np.sort(sh[a : b - SHINGLE + 1])
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
            elif b > a:
                u = mix((w[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                u = np.zeros(0, dtype=np.uint64)
            yield lo + r, u
