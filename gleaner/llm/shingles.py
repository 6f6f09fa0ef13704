"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(U) | U(1)
_SPAN = 1 << 14
with np.errstate(over="ignore"):
    _BASE = np.full(_SPAN, 0x9E3779B97F4A7C15, dtype=U)
    _BASE[0] = 1
    _POWER = np.multiply.accumulate(_BASE)
_TURN = _RNG.integers(1, 2**63 - 1, 32, dtype=np.int64).astype(U) | U(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every run of bytes other than ASCII white space."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[a]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return start, np.zeros(0, U)
    size = end - start
    at = np.flatnonzero(inside[1:-1])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    off = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[a[at]] * _POWER[off % _SPAN], first)
        h = mix(h + size.astype(U) * U(0x632BE59BD9B4E019))
    for i in np.flatnonzero(size > _SPAN):
        h[i] = U(xxhash.xxh3_64_intdigest(data[start[i] : end[i]]))
    return start, h


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct int64 hashes of its shingles of width words.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Fewer words than width make one shingle
    of them all, no words an empty set.
    """
    data = b"\n".join(texts).lower()
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, h = word_hashes(data)
    first = np.searchsorted(start, bounds)
    with np.errstate(over="ignore"):
        x = h * _TURN[0] if len(h) else h
        for i in range(1, width):
            x = mix(x[: len(h) - i] + h[i:] * _TURN[i]) if len(h) > i else x[:0]
    x = x.view(np.int64)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(x[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=b - a)], dtype=U).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
