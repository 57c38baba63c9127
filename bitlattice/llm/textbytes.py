"""Vectorised hashing of UTF-8 bytes, used inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random value for each byte, and an odd base with its inverse modulo 2**64.
BYTE = _RNG.integers(1, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE_INV**i for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, BASE_INV)):
                steps = np.full(size, b, dtype=U)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[0] = 0; the hash of data[s:e] is (S[e] - S[s]) * BASE_INV**s."""
    out = np.zeros(len(data) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word (run of bytes other than ASCII white space) starts and ends."""
    edge = np.diff(np.concatenate(([True], SPACE[np.frombuffer(data, dtype=np.uint8)], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return span_hashes(prefix_sums(np.frombuffer(data, dtype=np.uint8)), *word_places(data))
