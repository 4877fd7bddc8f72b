"""Numpy helpers that run inside tasks: rolling hashes of bytes, word shingles, sketches.

Hashes are polynomials over the 64-bit ring with a fixed random value per byte, so that prefix
sums give the hash of any stretch of a text, followed by a bit mixer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_powers = np.ones(1, U)
_inverses = np.ones(1, U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U(1), np.full(size - 1, _BASE, U)])
            _inverses = np.cumprod(np.r_[U(1), np.full(size - 1, inverse, U)])


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] the weighted sum of the first i bytes."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * _powers[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), not yet mixed."""
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * _inverses[start]


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hashes of all stretches of k bytes, by start."""
    n = len(sums) - k
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        return (sums[k:] - sums[:-k]) * _inverses[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every white-space separated word, in order."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        return mix64(stretch_hashes(prefix_sums(data), start, end)
                     + (end - start).astype(U)), start


def chunks(texts: list[str], limit: int = 1 << 19):
    """Runs of encoded texts of about ``limit`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append((text or "").encode())
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def shingle_sets(texts: list[str], k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles, lower-cased in ASCII; the
    whole text is the shingle of one with fewer words, and a text without words has none."""
    factors = [pow(_BASE, 2 * j + 1, 1 << 64) for j in range(k)]
    for run in chunks(texts):
        data = LOWER[np.frombuffer(b"\n".join(run) + b"\n", np.uint8)]
        words, start = word_hashes(data)
        edges = np.cumsum([0] + [len(t) + 1 for t in run])
        at = np.searchsorted(start, edges)
        n = len(words) - k + 1
        with np.errstate(over="ignore"):
            grams = mix64(sum(words[j: n + j] * U(factors[j]) for j in range(k))) \
                if n > 0 else np.empty(0, U)
            for a, b in zip(at[:-1], at[1:]):
                if b - a >= k:
                    yield np.unique(grams[a: b - k + 1])
                elif b > a:
                    own = sum(words[a + j: a + j + 1] * U(factors[j]) for j in range(b - a))
                    yield mix64(own + U(b - a))
                else:
                    yield np.empty(0, U)


# HyperMinHash: 2^P buckets, a 6-bit leading-zero count and R bits of what follows.
P, R = 8, 10
_BOUNDS = (np.arange(1 << P, dtype=np.uint64) << U(64 - P))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16, 0 empty) of a sorted shingle set: the smallest rest in each bucket, as
    its number of leading zeros and its first R bits after the leading one."""
    out = np.zeros(1 << P, np.uint16)
    if len(shingles) == 0:
        return out
    at = np.searchsorted(shingles, _BOUNDS)
    bucket = shingles >> U(64 - P)
    full = np.flatnonzero((at < len(shingles)) & (bucket[np.minimum(at, len(shingles) - 1)]
                                                  == np.arange(1 << P)))
    rest = shingles[at[full]] << U(P)  # the rest, at the top of the word
    high = rest >> U(32)
    top = np.where(high > 0, high, rest & U(0xFFFFFFFF)).astype(np.float64)
    length = np.where(top > 0, np.frexp(top)[1], 0) + np.where(high > 0, 32, 0)
    zeros = np.minimum(64 - length, 62)
    mantissa = ((rest << (zeros + 1).astype(U)) >> U(64 - R)).astype(np.int64)
    out[full] = ((zeros + 1) << R) | mantissa
    return out


def estimate(ones: np.ndarray, many: np.ndarray, n_ones: np.ndarray,
             n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketches against sketches, corrected for chance collisions, and the
    number of registers in use. Arguments broadcast against each other."""
    used = ((ones != 0) | (many != 0)).sum(axis=-1)
    same = ((ones == many) & (ones != 0)).sum(axis=-1)
    n, m = n_ones.astype(np.float64), n_many.astype(np.float64)
    chance = 0.169919487159739 * 2.0 ** (1 - R) * 4 * n * m / np.maximum((n + m) ** 2, 1)
    return np.where(used > 0, same / np.maximum(used, 1) - chance, 0.0), used


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """Per sketch (a row) a key per band of ``rows`` registers; 0 for a band without a value."""
    n, width = registers.shape
    parts = registers[:, : width // rows * rows].reshape(n, -1, rows).astype(U)
    key = np.tile(np.arange(1, parts.shape[1] + 1, dtype=U), (n, 1))
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix64(key * U(_BASE) + parts[:, :, j])
    key[key == 0] = 1
    return np.where(parts.any(axis=2), key, U(0))
