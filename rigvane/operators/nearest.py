"""Nearest distances between two point sets in n log n: a balanced k-d tree whose levels are built and searched for all points at once."""

from __future__ import annotations

import numpy as np

#: Points in a leaf, at most, and queries that are worked on together.
LEAF, QUERIES = 12, 1 << 13


class PointTree:
    """All leaves lie on one level; node i of a level has the children 2i and 2i + 1.

    Distances are computed as those of plain loops are (squares of x, y and z added in this order), and a node's box is never farther than a
    point in it, also in rounded numbers, so what is left out cannot be nearer."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, float)
        n, perm = len(self.points), np.arange(len(points))
        self.levels = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
        bounds = np.array([0, n])
        for _ in range(self.levels):
            starts, p = bounds[:-1], self.points[perm]
            axis = (np.maximum.reduceat(p, starts) - np.minimum.reduceat(p, starts)).argmax(axis=1)
            node = np.repeat(np.arange(len(starts)), np.diff(bounds))
            perm = perm[np.lexsort((p[np.arange(n), axis[node]], node))]
            bounds = np.sort(np.concatenate([bounds, starts + np.diff(bounds) // 2]))
        self.points, self.bounds = self.points[perm], bounds
        low, high = np.minimum.reduceat(self.points, bounds[:-1]), np.maximum.reduceat(self.points, bounds[:-1])
        self.boxes = [(low, high)]
        for _ in range(self.levels):
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.boxes.insert(0, (low, high))

    def _to_box(self, q: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        low, high = self.boxes[level]
        gap = np.maximum(np.maximum(low[node] - q, q - high[node]), 0.0)
        gap *= gap
        return gap[:, 0] + gap[:, 1] + gap[:, 2]

    def _to_leaf(self, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Least squared distance of each q to the points of its leaf."""
        start, size = self.bounds[leaf], self.bounds[leaf + 1] - self.bounds[leaf]
        best = np.full(len(q), np.inf)
        for k in range(int(size.max(initial=0))):
            d = q - self.points[start + np.minimum(k, size - 1)]
            d *= d
            np.minimum(best, d[:, 0] + d[:, 1] + d[:, 2], out=best)
        return best

    def squared(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to its nearest point."""
        out = np.empty(len(queries))
        for i in range(0, len(queries), QUERIES):
            out[i : i + QUERIES] = self._squared(np.asarray(queries[i : i + QUERIES], float))
        return out

    def _squared(self, q: np.ndarray) -> np.ndarray:
        node = np.zeros(len(q), np.int64)
        for level in range(1, self.levels + 1):  # straight down, for a first distance
            left, right = self._to_box(q, level, 2 * node), self._to_box(q, level, 2 * node + 1)
            node = 2 * node + (right < left)
        best, near = self._to_leaf(q, node), node
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(1, self.levels + 1):  # all nodes that may hold a nearer point
            who, node = np.repeat(who, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
            keep = self._to_box(q[who], level, node) < best[who]
            who, node = who[keep], node[keep]
        other = node != near[who]
        who, node = who[other], node[other]
        if len(who):
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            best[who[first]] = np.minimum(best[who[first]], np.minimum.reduceat(self._to_leaf(q[who], node), first))
        return best


def chamfer(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The mean of both directions' mean nearest distances; infinite if a set is empty."""
    if a is None or b is None or not len(a) or not len(b):
        return float("inf")
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(0.5 * (np.sqrt(PointTree(b).squared(a)).mean() + np.sqrt(PointTree(a).squared(b)).mean()))
