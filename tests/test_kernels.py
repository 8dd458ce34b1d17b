"""Peaks, assignment and filters against small cases and brute force."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.config import DEFAULT
from tempora.functions import peaks
from tempora.functions.assignment import assign
from tempora.functions.motion import Filters


@pytest.mark.parametrize(
    ("y", "threshold", "expected"),
    [([0, 1, 0], 0.5, [1]), ([1, 0, 1], 0.5, []), ([0, 1, 1, 0], 0.5, [1]), ([0, 1, 1, 2, 0], 0.5, [3]), ([0, 2, 1.9, 2, 0], 0.5, [1, 3]), ([0, 3, 2.8, 2.9, 0], 0.5, [1]), ([], 0.5, []), ([1], 0.5, []), ([2, 2, 2], 0, [])],
)
def test_maxima(y, threshold, expected):
    assert peaks.find(y, threshold).tolist() == expected


def slow_peaks(y, prominence, width=None):
    out, n, i = [], len(y), 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            p = (i + j) // 2
            left = right = y[p]
            k = p
            while k >= 0 and y[k] <= y[p]:
                left, k = min(left, y[k]), k - 1
            k = p
            while k < n and y[k] <= y[p]:
                right, k = min(right, y[k]), k + 1
            h = y[p] - max(left, right)
            level = y[p] - 0.5 * h
            a = p
            while y[a] > level:
                a -= 1
            b = p
            while y[b] > level:
                b += 1
            x = a + ((level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else 0)
            z = b - ((level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else 0)
            if h >= prominence and (width is None or z - x >= width):
                out.append(p)
        i = j + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.sampled_from([1.0, 2.0, 3.0]), st.sampled_from([None, 1.0, 2.0, 3.5]))
def test_peaks_as_the_slow_way(y, prominence, width):
    assert peaks.find(y, prominence, width).tolist() == slow_peaks([float(v) for v in y], prominence, width)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 4), st.integers(0, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = assign(cost)
    k = min(n, m)
    assert len(got) == k == len({r for r, _ in got}) == len({c for _, c in got})
    best = 0 if not k else min(sum(cost[r, c] for r, c in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else min(sum(cost[r, c] for r, c in zip(p, range(m))) for p in permutations(range(n), m))
    assert sum(cost[r, c] for r, c in got) == best


def test_filter_step():
    f = Filters(DEFAULT)
    f.add(0.5, 0.5)
    f.predict(np.array([1 / 30]))
    assert f.at[0] == pytest.approx([0.5, 0.5, 0, 3.3333e-05], abs=1e-9)
    f.update(0, 0.51, 0.48)
    assert f.at[0] == pytest.approx([0.50999012, 0.48001976, 3.2934460e-04, -6.2535588e-04], abs=1e-8)


def test_filter_as_matrices():
    """The shared 2 x 2 covariance against the full 4 x 4 filter."""
    rng, f = np.random.default_rng(3), Filters(DEFAULT)
    f.add(0.4, 0.6)
    x, p = np.array([0.4, 0.6, 0, 0]), np.eye(4)
    q, r, h = np.diag([0.01, 0.01, 0.1, 0.1]), np.eye(2) * 0.001, np.eye(2, 4)
    for _ in range(20):
        dt, z = rng.uniform(0.01, 0.1), rng.uniform(0, 1, 2)
        step = np.eye(4)
        step[0, 2] = step[1, 3] = dt
        x, p = step @ x, step @ p @ step.T + q
        x[3] += 0.001 * dt
        f.predict(np.array([dt]))
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        x, p = x + k @ (z - h @ x), (np.eye(4) - k @ h) @ p
        f.update(0, *z)
        assert f.at[0] == pytest.approx(x, abs=1e-10)
