"""Optimal assignment of rows to columns by shortest augmenting paths with potentials."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost, min(rows, columns) of them, by row."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    if n == 1:
        return [(0, int(cost[0].argmin()))]
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, via = cost[row] - u[row] - v, np.full(m, -1)
        done = np.zeros(m, bool)
        while True:
            open_ = np.where(done, np.inf, reach)
            col = int(open_.argmin())
            done[col] = True
            if owner[col] < 0:
                break
            r = owner[col]
            through = reach[col] + cost[r] - u[r] - v
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], col
        least = reach[col]
        settled = np.flatnonzero(done)
        settled = settled[settled != col]
        u[owner[settled]] += least - reach[settled]
        u[row] += least
        v[settled] -= least - reach[settled]
        while via[col] >= 0:
            owner[col] = owner[via[col]]
            col = int(via[col])
        owner[col] = row
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)
