"""Hashes of words and word shingles over whole batches of texts, vectorised."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 2, r, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.searchsorted(starts, bounds)
    return hashes, np.diff(at)


def shingle_hashes(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, and how many each text has.

    A text of fewer words has one shingle of them all; one without words none.
    """
    words, n = word_hashes(texts)
    out_n = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    # the first word of each shingle, and the words it has
    owner = np.repeat(np.arange(len(n)), out_n)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(out_n) - out_n)[owner]
    length = np.minimum(n, size)[owner]
    acc = length.astype(np.uint64)
    for k in range(size):
        there = k < length
        w = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(len(at), np.uint64)
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + np.where(there, w, np.uint64(0)))
    return acc, out_n
