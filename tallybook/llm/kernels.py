"""Numpy helpers on the bytes of many texts at once; all of them run inside Spark tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = [U(0x9E3779B97F4A7C15 | 5), U(0xC2B2AE3D27D4EB4F | 5), U(0xD6E8FEB86659FD93 | 5)]
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i <= n; odd bases have inverses."""
    have = _POW.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, int(n * 1.25) + 2)
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        have = _POW[which] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each span, by prefix sums of a polynomial."""
    n = len(values)
    up, down = powers(which, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(values * up[:n], dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows_hash(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of length values."""
    n = len(values)
    if n < length:
        return np.empty(0, U)
    up, down = powers(which, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(values * up[:n], dtype=U, out=sums[1:])
    return mix((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1])


class Words:
    """Words of many texts: starts and ends in buf, 64-bit hashes, and first[d]:first[d + 1] for text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.texts = texts = [t or b"" for t in texts]
        joined = b" ".join(texts)
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = LOWER[buf]
        self.buf = buf
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~SPACE[buf]
        change = np.diff(inside)
        self.starts = np.flatnonzero(change == 1)
        self.ends = np.flatnonzero(change == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = spans_hash(_BYTE[buf], self.starts, self.ends) if len(self.starts) else np.empty(0, U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def window_starts(self, length: int) -> np.ndarray:
        """True where a window of so many words of one text starts."""
        n = len(self.starts)
        ok = np.zeros(max(0, n - length + 1), bool)
        for a, b in zip(self.first[:-1], self.first[1:]):
            if b - a >= length:
                ok[a : b - length + 1] = True
        return ok


def byte_sums(buf: np.ndarray, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial over bytes, and the inverse powers, for sums_hash."""
    n = len(buf)
    up, down = powers(which, n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[:n], dtype=U, out=sums[1:])
    return sums, down


def sums_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span."""
    return mix((sums[ends] - sums[starts]) * down[starts])


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """True for the places that a window from one of the starts covers."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0
