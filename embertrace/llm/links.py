"""A forest over numbered points: which points are connected by the pairs given so far."""

from __future__ import annotations

import numpy as np


class Forest:
    """``label`` has one point of its component for each point, the lowest of them."""

    def __init__(self, points: int):
        self.label = np.arange(points)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Connect points ``i`` with points ``j``, one by one."""
        label = self.label
        while True:
            one, two = label[i], label[j]
            apart = one != two
            if not apart.any():
                return
            i, j, one, two = i[apart], j[apart], one[apart], two[apart]
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label[:] = further

    def join_all(self, on: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Connect ``i[p]`` with ``j[q]`` wherever ``on[p, q]``."""
        p, q = np.nonzero(on)
        self.join(i[p], j[q])
