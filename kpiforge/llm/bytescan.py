"""Hashes of many byte strings of one text at once (numpy), by differences of a running polynomial."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.ones(n, dtype=np.uint64)
        size = 1
        while size < n:
            step = np.uint64(pow(base, size, 1 << 64))
            p[size : 2 * size] = p[: min(size, n - size)] * step
            size *= 2
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def running(data: np.ndarray) -> np.ndarray:
    """prefix[i]: the polynomial of the first i bytes."""
    power = powers(len(data))[0]
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return prefix


def hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end) for arrays of bounds; equal bytes have equal hashes."""
    inverse = powers(len(prefix))[1]
    return mixed((prefix[end] - prefix[start]) * inverse[start])


def texts_of(column) -> list[bytes]:
    """The values of an Arrow binary column as bytes, null as empty."""
    return [v if v is not None else b"" for v in column.to_pylist()]
