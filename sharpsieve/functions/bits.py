"""Kernels over blocks of fingerprints (longs), in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows and columns that are compared at once: 2 MB of differences.
TILE = (64, 4096)


def close(a: np.ndarray, b: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and in b, and distances, of the pairs that differ in `most` bits at most, a tile at a time; without b the pairs inside a, each once."""
    one = a.view(np.uint64)
    two = one if b is None else b.view(np.uint64)
    rows, columns = TILE
    for i in range(0, len(one), rows):
        for j in range(i - i % columns if b is None else 0, len(two), columns):
            gaps = np.bitwise_count(one[i : i + rows, None] ^ two[None, j : j + columns])
            x, y = np.divmod(np.flatnonzero(gaps <= most), gaps.shape[1])
            if b is None:
                later = y + j > x + i
                x, y = x[later], y[later]
            if len(x):
                yield x + i, y + j, gaps[x, y].astype(np.int32)


class Forest:
    """Sets of the numbers below n that are joined step by step; root: the smallest of each number's set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            x, y = self.root[x], self.root[y]
            apart = x != y
            if not apart.any():
                return
            x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            self.root[y] = x  # where a root is to go under several, one counts now and the others in the next turn
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
