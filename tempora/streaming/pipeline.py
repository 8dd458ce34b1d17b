"""The live pipeline, frame by frame: mirror, background, commands, registration, detection, tracking, peaks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora.config import DEFAULT, Settings
from tempora.functions import peaks, vision
from tempora.operators.tracking import Tracker, full_scan, regions

BACKGROUND, REGISTRATION, TRACKED = "background", "registration", "tracked"
RESCAN, RETICLE = 5, 50
OUT = "video_id string, frame_idx int, timestamp double, status string, scan string, detections int, tracks int, peak_count long"


def _square(box: tuple) -> bool:
    """Large enough and nearly square: neither noise nor a hand."""
    w, h = int(box[2]) - int(box[0]), int(box[3]) - int(box[1])
    return w * h > 800 and h > 0 and 0.8 < w / h < 1.2


@dataclass
class LivePipeline:
    """What one video's frames need of those before. The detector has detect(), detect_in(), register(), reset() and
    register_background(), as vision.SignatureDetector has."""

    detector: object = field(default_factory=vision.SignatureDetector)
    settings: Settings = DEFAULT
    registering: bool = False
    label: str | None = None
    pending_background: bool = False
    frames: int = 0
    peak_count: int = 0
    background: vision.Background = field(default_factory=vision.Background)
    latest: dict[int, tuple[float, float]] = field(default_factory=dict)
    history: dict[int, list] = field(default_factory=dict)
    last_peak: dict[int, float] = field(default_factory=dict)

    def __post_init__(self):
        self.tracker = Tracker(self.settings, max_distance=self.settings.live_max_distance, gravity=self.settings.live_gravity)

    def retune(self, gravity: float | None = None, interpolate: bool | None = None, **detector: object) -> None:
        """New parameters for the frames to come: the tracker's, and the detector's by name."""
        self.tracker.retune(gravity, interpolate)
        for name, value in detector.items():
            setattr(self.detector, name, value)

    def step(self, picture: np.ndarray, time: float, ball: bool = False, background: bool = False, reset: bool = False) -> tuple[str, str, int]:
        """What became of the frame, how it was scanned, and how many detections it has."""
        picture = vision.mirrored(picture)
        if self.pending_background:
            self.detector.register_background(picture)
            self.pending_background = False
            return BACKGROUND, "", 0
        height, width = picture.shape[:2]
        motion = self.background.apply(picture)
        if ball:
            self.label, self.registering = "Ball (Voice)", True
        if background:  # taken by the next frame
            self.pending_background = True
        if reset:
            self.detector.reset()
        if self.registering:
            if self.label is not None:
                x, y = width // 2, height // 2
                self.detector.register(picture, (x - RETICLE, y - RETICLE, x + RETICLE, y + RETICLE), self.label)
                self.label = None
            return REGISTRATION, "", 0
        found, scan = self._detections(picture, time, motion)
        self._track(found, time, width, height)
        return TRACKED, scan, len(found)

    def _detections(self, picture: np.ndarray, time: float, motion: np.ndarray) -> tuple[list, str]:
        predictions = self.tracker.predictions(time) if self.tracker.live else {}
        if full_scan(self.frames, predictions, bool(self.tracker.live), self.settings.full_scan_every):
            return self.detector.detect(picture, motion=motion), "full"
        found = [d for d in self.detector.detect_in(picture, regions(predictions, self.settings.roi_scale)) if _square(d)]
        scan = "regions"
        if not found:
            found, scan = self.detector.detect(picture, motion=motion), "full"
        if self.frames % RESCAN == 0:  # objects outside the regions; those inside may come twice
            found = [*found, *self.detector.detect(picture, motion=motion)]
        return found, scan

    def _track(self, found: list, time: float, width: int, height: int) -> None:
        boxes = np.array([d[:5] for d in found], float).reshape(-1, 5)
        for track, _, stamp, _, y, _, _ in self.tracker.step(self.frames, time, boxes, width, height):
            self.latest[track] = stamp, y
        self.frames += 1
        live = {t.id for t in self.tracker.live}
        for kept in (self.latest, self.history, self.last_peak):
            for track in kept.keys() - live:
                del kept[track]
        for track in sorted(live):
            past = self.history[track] = [*self.history.get(track, ()), self.latest[track]][-self.settings.live_history :]
            if len(past) >= self.settings.min_points:
                for i in peaks.find(-np.array([y for _, y in past]), self.settings.live_prominence):
                    if past[i][0] > self.last_peak.get(track, 0.0):
                        self.last_peak[track] = past[i][0]
                        self.peak_count += 1


def live_pipeline(frames: DataFrame, make=LivePipeline, idle: str | None = None) -> DataFrame:
    """One row a frame of a stream frames(video_id, frame_idx, timestamp, width, height, frame, ball, background, reset),
    frame being rows of blue, green and red bytes. A frame that cannot be read is passed over. A video's state, which is
    bounded by its live tracks and registered objects, goes after `idle` (such as "10 minutes") without frames; a query with
    it looks for such videos as long as it runs, so it never ends by itself."""
    names = [x.split()[0] for x in OUT.split(", ")]
    seconds = 0 if idle is None else pd.Timedelta(idle).total_seconds()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = pickle.loads(state.get[0]) if state.exists else make()
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_idx").itertuples():
            try:
                picture = np.frombuffer(r.frame, np.uint8).reshape(int(r.height), int(r.width), 3)
            except (TypeError, ValueError):
                out.append((key[0], r.frame_idx, r.timestamp, "unread", "", 0, len(p.tracker.live), p.peak_count))
                continue
            done = p.step(picture, float(r.timestamp), bool(r.ball), bool(r.background), bool(r.reset))
            out.append((key[0], r.frame_idx, r.timestamp, *done, len(p.tracker.live), p.peak_count))
        state.update((pickle.dumps(p),))
        if seconds:
            state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame(out, columns=names)

    return frames.groupBy("video_id").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if seconds else GroupStateTimeout.NoTimeout)
