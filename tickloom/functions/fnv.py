"""FNV-1a over long byte streams, vectorised and splittable.

h -> (h xor b) * p mod 2^64. The xor touches only the low byte, and the low byte of the
product depends only on the low byte of the state. So with the low byte known at every step,
d = (h xor b) - h is a known small number and the step is affine: h' = (h + d) * p. A block of
n bytes then maps h to h * p^n + c.

* ``low_byte_map``  for all 256 possible low bytes at the block start, the one at its end
* ``affine_part``   c for a known start low byte

A long chain is cut into blocks, the low-byte maps are chained, and the affine parts follow in
parallel.
"""

from collections.abc import Sequence

import numpy as np

# Fixed values of 64-bit FNV-1a.
OFFSET = 14695981039346656037
PRIME = 1099511628211

_MASK = (1 << 64) - 1
_LOW = np.uint8(PRIME & 0xFF)
_SEGMENT = 256


def fnv1a(data: bytes, seed: int = OFFSET) -> int:
    """Plain chain for short inputs."""
    for byte in data:
        seed = ((seed ^ byte) * PRIME) & _MASK
    return seed


def low_byte_map(data: np.ndarray) -> np.ndarray:
    """uint8[256]: end low byte for every start low byte."""
    identity = np.arange(256, dtype=np.uint8)
    whole = data.size // _SEGMENT * _SEGMENT
    result = identity
    rows = data[:whole].reshape(-1, _SEGMENT)
    for start in range(0, rows.shape[0], 1024):
        part = rows[start : start + 1024]
        states = np.broadcast_to(identity, (part.shape[0], 256)).copy()
        for step in range(_SEGMENT):
            np.bitwise_xor(states, part[:, step, None], out=states)
            np.multiply(states, _LOW, out=states)
        for segment in states:
            result = segment[result]
    for byte in data[whole:]:
        result = (result ^ byte) * _LOW
    return result


def low_bytes(data: np.ndarray, start: int) -> np.ndarray:
    """Low byte of the state before every byte, for a known start.

    Bit k after a step is bit k of (state xor byte) xored with a function of the lower bits,
    because the multiplier is odd. With the lower bits known, bit k is a running xor.
    """
    states = np.zeros(data.size, dtype=np.uint8)
    for bit in range(8):
        mask = np.uint8((1 << bit) - 1)
        product = ((states ^ data) & mask) * _LOW
        flips = ((product ^ data) >> np.uint8(bit)) & np.uint8(1)
        running = np.bitwise_xor.accumulate(flips)
        first = np.uint8((start >> bit) & 1)
        states[0] |= first << np.uint8(bit)
        states[1:] |= (running[:-1] ^ first) << np.uint8(bit)
    return states


def affine_part(data: np.ndarray, start: int) -> int:
    """c of h * p^n + c for a block whose start state has the given low byte."""
    if data.size == 0:
        return 0
    states = low_bytes(data, start)
    steps = ((states ^ data).astype(np.int64) - states.astype(np.int64)).astype(np.uint64)
    total = np.uint64(0)
    chunk = 1 << 16
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(chunk, PRIME, dtype=np.uint64), dtype=np.uint64)
        for begin in range(0, data.size, chunk):
            part = steps[begin : begin + chunk]
            n = part.size
            total = total * powers[n - 1] + np.sum(part * powers[n - 1 :: -1][:n], dtype=np.uint64)
    return int(total)


def running(data: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """State after each of the byte counts ``ends`` (ascending) from a known start state.

    The prime is odd, so it has an inverse q: state_n = p^n * (start + sum of d_i * q^i).
    """
    if data.size == 0:
        return np.full(ends.size, start, dtype=np.uint64)
    states = low_bytes(data, start & 0xFF)
    steps = ((states ^ data).astype(np.int64) - states.astype(np.int64)).astype(np.uint64)
    inverse = np.uint64(pow(PRIME, -1, 1 << 64))
    with np.errstate(over="ignore"):
        down = np.full(data.size, inverse, dtype=np.uint64)
        down[0] = 1
        sums = np.cumsum(steps * np.cumprod(down, dtype=np.uint64), dtype=np.uint64)
        up = np.cumprod(np.full(data.size, PRIME, dtype=np.uint64), dtype=np.uint64)
        at = np.maximum(ends, 1) - 1
        after = up[at] * (np.uint64(start) + sums[at])
    return np.where(ends > 0, after, np.uint64(start))


def chain_rows(seeds: np.ndarray, payloads: Sequence[bytes]) -> np.ndarray:
    """One independent chain per row, vectorised across rows."""
    lengths = np.fromiter((len(p) for p in payloads), dtype=np.int64, count=len(payloads))
    width = int(lengths.max()) if lengths.size else 0
    table = np.zeros((lengths.size, width), dtype=np.uint8)
    for i, payload in enumerate(payloads):
        table[i, : lengths[i]] = np.frombuffer(payload, dtype=np.uint8)
    state = seeds.astype(np.uint64)
    prime = np.uint64(PRIME)
    with np.errstate(over="ignore"):
        for column in range(width):
            moved = (state ^ table[:, column].astype(np.uint64)) * prime
            state = np.where(column < lengths, moved, state)
    return state


def advance(seed: int, length: int, part: int) -> int:
    """State after a block of ``length`` bytes with affine part ``part``."""
    return (seed * pow(PRIME, length, 1 << 64) + part) & _MASK
