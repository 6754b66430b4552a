"""Vectorised hashing of byte strings, for Arrow batches."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; n + 1 numbers for n codes."""
    up, _ = _powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end], equal for equal spans wherever they stand."""
    _, down = _powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start])


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a code array."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pre = prefix(codes)
    _, down = _powers(len(pre))
    return mix((pre[k:] - pre[:n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w, by doubling."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while 2 * have <= w:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    edge = np.diff(np.concatenate(([1], _SPACE[data].view(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
