"""Words of many texts at once as 64-bit hashes, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of byte ranges of `buf`: equal bytes have equal hashes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * up[:len(buf)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def blocks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of the texts): runs of texts of about `limit` bytes, each text with a blank behind it."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append(raw)
        size += len(raw) + 1
        if size >= limit or i + 1 == len(texts):
            yield first, np.frombuffer(b" ".join([*held, b""]), np.uint8), np.cumsum([0] + [len(r) + 1 for r in held[:-1]])
            held, size, first = [], 0, i + 1


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element is False."""
    flips = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return flips[::2], flips[1::2]
