"""Assignment algorithms on small matrices: plain functions without Spark."""

from __future__ import annotations

import numpy as np

INVALID = 1e6


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """D-14: one-to-one pairs of least total cost, by shortest augmenting paths; costs of INVALID mean "no pair" and are
    only used if nothing else is left, then dropped (C-13)."""
    n, m = cost.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in optimal(cost.T))
    u, v = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for i in range(n):
        owner[m] = i
        j, dist, prev, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[j] >= 0:
            done[j] = True
            row = owner[j]
            open_ = ~done[:m]
            step = cost[row] - u[row] - v[:m]
            better = open_ & (step < dist)
            dist[better], prev[better] = step[better], j
            k = int(np.argmin(np.where(open_, dist, np.inf)))
            delta = dist[k]
            u[owner[done]] += delta
            v[done] -= delta
            dist[open_] -= delta
            j = k
        while j != m:
            owner[j] = owner[prev[j]]
            j = prev[j]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and cost[owner[j], j] < INVALID)


def greedy(edges: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """D-15, G-3: edges (score, a, b) in descending order; an edge is taken if both ends are free."""
    left, right, out = set(), set(), []
    for _, a, b in sorted(edges, reverse=True):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return out


def suppress(n: int, iou: dict[tuple[int, int], float], level: float, capacity: int) -> list[int]:
    """F-2, G-6: ranks in order; one is kept unless it overlaps a kept one by `level` or more; stops at the capacity."""
    kept: list[int] = []
    for i in range(n):
        if len(kept) >= capacity:
            break
        if all(iou.get((min(i, k), max(i, k)), 0.0) < level for k in kept):
            kept.append(i)
    return kept


def constrained_groups(views: list[int], edges: list[tuple[float, int, int]]) -> list[int]:
    """E-16: observations (with their views) grouped along edges (score, a, b) in descending order; two groups are joined only if
    they have no view in common, the larger one's root stays.  Group numbers by first observation (E-20)."""
    root = list(range(len(views)))
    seen = [{v} for v in views]
    members = [[i] for i in range(len(views))]
    for _, a, b in sorted(edges, reverse=True):
        x, y = root[a], root[b]
        if x == y or seen[x] & seen[y]:
            continue
        if len(members[x]) < len(members[y]):
            x, y = y, x
        for i in members[y]:
            root[i] = x
        members[x] += members[y]
        seen[x] |= seen[y]
    number: dict[int, int] = {}
    return [number.setdefault(r, len(number) + 1) for r in root]
