"""Constant-velocity Kalman filters, many at once.

Start, process and measurement noise are the same on both axes and have no cross terms, so the axes share one 2 x 2
covariance (position, velocity) and the filter is a handful of array formulas over all live tracks.
"""

from __future__ import annotations

import numpy as np

from tempora.config import DEFAULT, Settings


class Filters:
    """Columns of `at`: x, y, vx, vy; of `cov`: position variance, covariance, velocity variance."""

    def __init__(self, settings: Settings = DEFAULT, gravity: float | None = None):
        self.settings, self.gravity = settings, settings.gravity if gravity is None else gravity
        self.at, self.cov = np.zeros((0, 4)), np.zeros((0, 3))

    def add(self, x: float, y: float) -> None:
        self.at = np.vstack([self.at, [x, y, 0.0, 0.0]])
        self.cov = np.vstack([self.cov, [1.0, 0.0, 1.0]])

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.cov = self.at[mask], self.cov[mask]

    def predict(self, dt: np.ndarray) -> None:
        """Gravity adds to the vertical speed only; the position follows in the next step."""
        self.at[:, :2] += self.at[:, 2:] * dt[:, None]
        self.at[:, 3] += self.gravity * dt
        p, c, v = self.cov.T
        q = self.settings.process_noise
        now = np.empty_like(self.cov)
        now[:, 0], now[:, 1], now[:, 2] = p + 2 * dt * c + dt * dt * v + q, c + dt * v, v + q * self.settings.velocity_noise_factor
        self.cov = now

    def update_all(self, rows: np.ndarray, seen: np.ndarray) -> None:
        """Each of the filters `rows` takes its measured position of `seen`."""
        p, c, v = self.cov[rows].T
        s = p + self.settings.measurement_noise
        gain, drift = p / s, c / s
        off = seen - self.at[rows, :2]
        self.at[rows, :2] += gain[:, None] * off
        self.at[rows, 2:] += drift[:, None] * off
        self.cov[rows] = np.stack([(1 - gain) * p, (1 - gain) * c, v - drift * c], axis=1)

    def update(self, i: int, x: float, y: float) -> None:
        self.update_all(np.array([i]), np.array([[x, y]]))
