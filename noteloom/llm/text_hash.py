"""Stable 64-bit hashes of words and word runs, computed for a whole text at once with numpy."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * _STEP)


_BYTES = seeds(256, 1000)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _powers


#: Bytes that are hashed at once.
CHUNK = 1 << 20


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash for each word: a polynomial over its bytes, from differences of one running sum. Memory is bounded by chunks of words, and of bytes in a longer word."""
    out = np.empty(len(words), np.uint64)
    start = size = 0
    for i, word in enumerate(words):
        size += 4 * len(word) + 1
        if size > CHUNK:
            if i > start:
                out[start:i] = _some_hashes(words[start:i])
            start, size = i, 4 * len(word) + 1
            if size > CHUNK:
                out[i] = _long_hash(word)
                start, size = i + 1, 0
    if start < len(words):
        out[start:] = _some_hashes(words[start:])
    return out


def _some_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)]
    gaps = np.flatnonzero(data == 32)
    start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    return mix((total[end] - total[start]) * inverse[start])


def _long_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
    power, total = _power_tables(CHUNK)[0][:CHUNK], 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        total += int((_BYTES[part] * power[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([total & ((1 << 64) - 1)], np.uint64))[0]


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; none if there are fewer words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(seeds(k, 2000)):
        total += hashes[j : j + n] * (c | np.uint64(1))
    return mix(total)
