"""Thresholds of every stage in one place; each operator takes them as parameters too."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: the thresholds that results depend on
    stride: int = 2
    test_frames: int = 500
    max_distance: float = 120.0
    live_max_distance: float = 100.0
    max_inactive: int = 10
    min_hits: int = 3
    gravity: float = 0.001
    live_gravity: float = 0.002
    process_noise: float = 0.01
    velocity_noise_factor: float = 10.0
    measurement_noise: float = 0.001
    size_alpha: float = 0.3
    default_size: float = 0.05
    roi_scale: float = 4.0
    full_scan_every: int = 30
    max_fill_gap: int = 10
    vertex_window: float = 0.7
    min_curvature: float = 1e-4
    min_active: int = 2
    min_on: float = 1.0
    min_off: float = 0.5
    segment_confidence: float = 0.8
    min_points: int = 5
    prominence: float = 0.02
    width: float = 2.0
    live_prominence: float = 0.05
    live_history: int = 20
    edge_y: float = 0.15
    edge_seconds: float = 0.4
    event_confidence: float = 0.9
    edge_confidence: float = 0.7
    run_gap: float = 1.0
    run_min: int = 3
    flash_seconds: float = 0.5
    fps_window: int = 30
    truth_total: int = 65
    truth_streak: int = 35


DEFAULT = Settings()
