"""Hashed n-grams of UTF-8 texts, in numpy; texts of any length are taken in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes taken at once.
PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x100000001B3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_UP, _DOWN = _powers(PIECE + 4096)


def pieces(data: bytes, overlap: int) -> Iterator[bytes]:
    """data in pieces of PIECE bytes; each repeats the last `overlap` bytes of the one before."""
    if len(data) <= PIECE:
        yield data
        return
    for at in range(0, len(data), PIECE - overlap):
        yield data[at : at + PIECE]
        if at + PIECE >= len(data):
            return


def byte_grams(data: bytes, n: int) -> np.ndarray:
    """The n-grams of bytes as numbers, mixed with n; n up to 7."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < n:
        return np.zeros(0, np.uint64)
    out = b[: len(b) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out = (out << np.uint64(8)) | b[k : len(b) - n + 1 + k]
    return (out + np.uint64(n << 56)) * _MIX


def word_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of data (at most PIECE + 4095 bytes), and of its pairs of neighbours."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[b], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], dtype=np.uint64)))
    words = (sums[ends] - sums[starts]) * _DOWN[starts] * _MIX
    words ^= words >> np.uint64(31)
    pairs = (words[:-1] * np.uint64(3) + words[1:]) * _MIX
    return words * _MIX, pairs
