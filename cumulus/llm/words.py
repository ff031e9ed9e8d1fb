"""Vectorised word hashes of a text (numpy, inside Spark tasks)."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time, so a text of any length needs bounded extra memory.
_CHUNK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]).cumprod(dtype=np.uint64)
                          for b in (np.uint64(_BASE), np.uint64(_INVERSE))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _chunk_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], ((raw.astype(np.uint64) + np.uint64(1)) * up[:-1]).cumsum(dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order. Equal words have equal hashes in every text."""
    if len(data) <= _CHUNK:
        return _chunk_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_chunk_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of k consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, _ = _powers(k + 1)
    h = words[:n] * up[1]
    for j in range(1, k):
        h = h + words[j:j + n] * up[j + 1]
    return mix(h)
