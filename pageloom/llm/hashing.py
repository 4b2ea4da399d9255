"""Hashes of byte runs, as numpy arrays over a whole stretch of text."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_cache: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if len(made) > 1 << 22:  # a very long text: not kept
            return made[:n]
        _cache[name] = have = made
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums of bytes before each place, 0 first, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers("base", _BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def runs(sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice, n: int) -> np.ndarray:
    """Hash of the bytes [start, stop) of each run; equal bytes give equal hashes wherever they stand. n: bytes in all."""
    back = _powers("inverse", pow(_BASE, -1, _MASK + 1), n + 1)
    return mixed((sums[stop] - sums[start]) * back[start])
