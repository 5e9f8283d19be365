"""Numpy scan of many texts at once: words, 64-bit hashes of words and ranges."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    """splitmix64's finaliser, on Python ints."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on arrays (wraps mod 2^64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_KEYS = np.array([_mix_int(i + 1) for i in range(256)], _U)
BASE = _mix_int(4242) | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Odd factors that place a word within a window.
PLACES = np.array([_mix_int(7000 + i) | 1 for i in range(16)], _U)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(m, b, _U)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def forget_large(limit: int = 1 << 23) -> None:
    """Drop the power tables after an exceptionally long text."""
    if "up" in _powers and len(_powers["up"]) > limit:
        _powers.clear()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of key(byte k) * BASE**k for i <= k < j; length n + 1."""
    up, _ = powers(max(len(data), 1))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_KEYS[data] * up[:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of bytes [start, end), wherever they stand."""
    _, down = powers(max(len(prefix), 1))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a slice of texts: ``starts``, ``ends`` (bytes), ``doc`` (row), in order."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        self.full = ~WS[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)  # a text begins or ends before this byte
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = self.full[:-1], self.full[1:]
        self.starts = np.flatnonzero(self.full & (~before | edge[:-1]))
        self.ends = np.flatnonzero(self.full & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return range_hash(prefix_hash(self.data) if prefix is None else prefix, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``width`` words within one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1:])
        h = np.zeros(n, _U)
        for i in range(width):
            h += hashes[i:i + n] * PLACES[i]
        return first, mix(h[first])


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Key that also holds the row, so that one sort serves all texts of a slice."""
    return mix(hashes ^ (doc.astype(_U) * _U(0xD6E8FEB86659FD93)))
