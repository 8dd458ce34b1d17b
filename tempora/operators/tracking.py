"""Linking detections into tracks: prediction, optimal assignment, life cycle, coasting.

A video is serial by nature: a frame's matches depend on all frames before it. Videos run in parallel, and a video's
frames stream through its task in order, so memory holds the live tracks and never the video.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora import schemas
from tempora.config import DEFAULT, Settings
from tempora.functions.assignment import assign
from tempora.functions.motion import Filters
from tempora.operators.folds import fold

TENTATIVE, CONFIRMED, DELETED = "TENTATIVE", "CONFIRMED", "DELETED"


def _r4(v: float) -> float:
    return round(v * 1e4) / 1e4


@dataclass
class _Live:
    id: int
    stamp: float
    size: tuple[float, float]
    hits: int = 1
    inactive: int = 0
    state: str = TENTATIVE


@dataclass
class Tracker:
    """The live tracks of one video. step() takes a frame's boxes and gives the points to write."""

    settings: Settings = DEFAULT
    interpolate: bool = True
    max_distance: float | None = None
    gravity: float | None = None
    next_id: int = 0
    live: list[_Live] = field(default_factory=list)

    def __post_init__(self):
        self.filters = Filters(self.settings, self.gravity)

    def retune(self, gravity: float | None = None, interpolate: bool | None = None) -> None:
        if gravity is not None:
            self.gravity = self.filters.gravity = gravity
        if interpolate is not None:
            self.interpolate = interpolate

    def step(self, frame: int, time: float, boxes: np.ndarray, width: int, height: int) -> list[tuple]:
        """boxes: (n, 5) of x1, y1, x2, y2 in pixels and confidence -> (track, frame, time, x, y, confidence, synthetic)."""
        s, scale = self.settings, np.array([width, height], float)
        centres = (boxes[:, :2] + boxes[:, 2:4]) / 2 / scale
        sizes = ((boxes[:, 2:4] - boxes[:, :2]) / scale).tolist()
        stamp, points = _r4(time), []
        seen = [(_r4(x), _r4(y), _r4(c)) for (x, y), c in zip(centres.tolist(), boxes[:, 4].tolist())]
        if self.live:
            dt = time - np.array([t.stamp for t in self.live])
            self.filters.predict(np.where(dt > 0, dt, 1 / 30))
        limit = s.max_distance if self.max_distance is None else self.max_distance
        matched: dict[int, int] = {}
        if self.live and len(boxes):
            off = (self.filters.at[:, None, :2] - centres[None]) * scale
            far = np.sqrt((off * off).sum(2))
            matched = {r: c for r, c in assign(far) if far[r, c] < limit}
            if matched:
                self.filters.update_all(np.array(list(matched)), centres[list(matched.values())])
        for r, t in enumerate(self.live):
            if r in matched:
                c = matched[r]
                t.size = tuple((1 - s.size_alpha) * a + s.size_alpha * b for a, b in zip(t.size, sizes[c]))
                t.inactive, t.hits, t.stamp = 0, t.hits + 1, stamp
                if t.hits >= s.min_hits:
                    t.state = CONFIRMED
                points.append((t.id, frame, stamp, *seen[c], False))
        coasting = np.clip(self.filters.at[:, :2], 0, 1).tolist() if self.interpolate and len(matched) < len(self.live) else []
        for r, t in enumerate(self.live):
            if r not in matched:
                t.inactive += 1
                if self.interpolate and t.state == CONFIRMED:
                    x, y = coasting[r]
                    points.append((t.id, frame, stamp, _r4(x), _r4(y), _r4(max(0.01, 0.1 * (1 - t.inactive / s.max_inactive))), True))
                    t.stamp = stamp
                if t.inactive >= s.max_inactive:
                    t.state = DELETED
        alive = [t.state != DELETED for t in self.live]
        if not all(alive):
            self.filters.keep(np.array(alive, bool))
            self.live = [t for t in self.live if t.state != DELETED]
        taken = set(matched.values())
        for c in range(len(boxes)):
            if c not in taken:
                self.live.append(_Live(self.next_id, stamp, tuple(sizes[c]), state=CONFIRMED if s.min_hits <= 1 else TENTATIVE))
                self.filters.add(*centres[c])
                points.append((self.next_id, frame, stamp, *seen[c], False))
                self.next_id += 1
        return points

    def predictions(self, time: float) -> dict[int, tuple[float, float, float, float]]:
        """Where each live track should be, clamped, with its size; without gravity."""
        out = {}
        for t, (x, y, vx, vy) in zip(self.live, self.filters.at):
            dt = time - t.stamp
            out[t.id] = (float(np.clip(x + vx * dt, 0, 1)), float(np.clip(y + vy * dt, 0, 1)), *t.size)
        return out

    def snapshot(self) -> list[tuple]:
        return [(t.id, t.state, t.hits, t.inactive, *map(float, at), *map(float, t.size)) for t, at in zip(self.live, self.filters.at)]


def full_scan(frame: int, predictions: dict, ever: bool, every: int = DEFAULT.full_scan_every) -> bool:
    """Whether a detector should look at the whole frame: each `every` frames, before any track, or without predictions."""
    return frame % every == 0 or not ever or not predictions


def regions(predictions: dict[int, tuple[float, float, float, float]], scale: float = DEFAULT.roi_scale) -> list[tuple[float, float, float, float]]:
    return [(x, y, w * scale, h * scale) for x, y, w, h in predictions.values()]


_POINTS = [x.split()[0] for x in schemas.TRACK_POINTS.split(", ")]
_STATES = [x.split()[0] for x in schemas.TRACK_STATES.split(", ")]


def _frames(batches: Iterator[pa.RecordBatch]):
    """(video, fps, width, height, frame_count, frame, boxes) in order; rows arrive sorted."""
    names = ["video_id", "fps", "width", "height", "frame_count", "frame_idx", "x1", "y1", "x2", "y2", "confidence"]
    now, boxes = None, []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            head = row[:6]
            if head != now:
                if now is not None:
                    yield now, np.array(boxes, float).reshape(-1, 5)
                now, boxes = head, []
            if row[6] is not None:
                boxes.append(row[6:])
    if now is not None:
        yield now, np.array(boxes, float).reshape(-1, 5)


def _run(settings: Settings, interpolate: bool, stride: int, states: bool = False):
    def points(batches):
        tracker = video = last = None

        def idle(until: int):
            """Frames without any detection, as long as there are tracks to age."""
            frame = last[5] + stride
            while frame < until and tracker.live:
                yield from tracker.step(frame, frame / last[1], np.zeros((0, 5)), last[2], last[3])
                frame += stride

        def ended():
            return tracker.snapshot() if states else ()

        for head, boxes in _frames(batches):
            if head[0] != video:
                if tracker is not None:
                    yield video, [*idle(last[4]), *ended()]
                tracker, video, last = Tracker(settings, interpolate), head[0], (*head[:5], -stride)
            yield video, [*idle(head[5]), *tracker.step(head[5], head[5] / head[1], boxes, head[2], head[3])]
            last = head
        if tracker is not None:
            yield video, [*idle(last[4]), *ended()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 6] if states else kinds

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], _STATES if states else _POINTS)

        for video, rows in points(batches):
            held += [(video, *r) for r in rows if len(r) == len(kinds) - 1]
            if len(held) > 5000:
                yield emit()
                held = []
        if held:
            yield emit()

    return run


def track(detections: DataFrame, videos: DataFrame, settings: Settings = DEFAULT, interpolate: bool = True, stride: int | None = None, test_mode: bool = False) -> DataFrame:
    """Track points of every video. Every `stride`-th frame counts, and only the first test_frames in test mode."""
    stride, used = _dealt(detections, videos, settings, stride, test_mode)
    return used.mapInArrow(_run(settings, interpolate, stride), schemas.TRACK_POINTS)


def track_states(detections: DataFrame, videos: DataFrame, settings: Settings = DEFAULT, interpolate: bool = True, stride: int | None = None, test_mode: bool = False) -> DataFrame:
    """The tracks that live at the end of every video, active and confirmed ones by `state`."""
    stride, used = _dealt(detections, videos, settings, stride, test_mode)
    return used.mapInArrow(_run(settings, interpolate, stride, states=True), schemas.TRACK_STATES)


def _dealt(detections: DataFrame, videos: DataFrame, settings: Settings, stride: int | None, test_mode: bool) -> tuple[int, DataFrame]:
    stride = settings.stride if stride is None else stride
    used = detections.where(F.col("frame_idx") % stride == 0)
    if test_mode:
        used = used.where(F.col("frame_idx") < settings.test_frames)
        videos = videos.withColumn("frame_count", F.least("frame_count", F.lit(settings.test_frames)))
    used = used.select("video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2", "confidence").join(videos.select("video_id", "fps", "width", "height", "frame_count"), "video_id")
    return stride, used.repartition("video_id").sortWithinPartitions("video_id", "frame_idx", "det_idx")


def match(left: DataFrame, right: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """(*keys, left_id, right_id, distance): per key the assignment of least total distance, then only pairs nearer than `limit`.

    left and right: (*keys, id, x, y). The assignment looks at all pairs of a key, so keys are meant to be small (a frame).
    """
    head = left.select(*keys).schema
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # fresh columns, where both sides come of one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("id"), b.sort_by("id")
        rows = []
        if a.num_rows and b.num_rows:
            p, q = (np.column_stack([t.column(c).to_numpy() for c in ("x", "y")]) for t in (a, b))
            far = np.linalg.norm(p[:, None] - q[None], axis=2)
            rows = [(*(a.column(k)[r].as_py() for k in keys), a.column("id")[r].as_py(), b.column("id")[c].as_py(), float(far[r, c])) for r, c in assign(far) if far[r, c] < limit]
        cols = list(zip(*rows)) if rows else [[]] * (len(keys) + 3)
        kinds = [a.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*keys, "left_id", "right_id", "distance"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", left_id long, right_id long, distance double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, out)


def unmatched(side: DataFrame, found: DataFrame, keys: list[str], matched: str) -> DataFrame:
    """Rows of a side of match() that no pair of its result holds; `matched` is left_id or right_id."""
    return side.join(found.select(*keys, F.col(matched).alias("id")), [*keys, "id"], "left_anti")


def scan_mode(frames: DataFrame, every: int = DEFAULT.full_scan_every, rescan: int | None = None) -> DataFrame:
    """frames(frame_idx, tracks, predictions, detections) plus `full`, and `again`: whether a scan of regions is followed
    by one of the whole frame, because it found nothing or, with `rescan`, each so many frames."""
    full = (F.col("frame_idx") % every == 0) | (F.col("tracks") == 0) | (F.col("predictions") == 0)
    again = F.col("detections") == 0
    if rescan is not None:
        again |= F.col("frame_idx") % rescan == 0
    return frames.withColumn("full", full).withColumn("again", ~full & again)


def smooth(rows: DataFrame, keys: list[str], order: str, time: str, x: str, y: str, settings: Settings = DEFAULT) -> DataFrame:
    """(*keys, order, x, y, vx, vy): one filter a key, updated by every row in order."""

    q, far, m, g = settings.process_noise, settings.process_noise * settings.velocity_noise_factor, settings.measurement_noise, settings.gravity

    def step(s: list, at, t, a, b):
        """The formulas of Filters for one object, on plain numbers."""
        if not s:
            s[:] = [t, a, b, 0.0, 0.0, 1.0, 0.0, 1.0]
            return [(at, a, b, 0.0, 0.0)]
        last, px, py, vx, vy, p, c, v = s
        dt = t - last if t > last else 1 / 30
        px, py, vy = px + vx * dt, py + vy * dt, vy + g * dt
        p, c, v = p + 2 * dt * c + dt * dt * v + q, c + dt * v, v + far
        gain, drift = p / (p + m), c / (p + m)
        dx, dy = a - px, b - py
        px, py, vx, vy = px + gain * dx, py + gain * dy, vx + drift * dx, vy + drift * dy
        s[:] = [t, px, py, vx, vy, (1 - gain) * p, (1 - gain) * c, v - drift * c]
        return [(at, px, py, vx, vy)]

    kind = dict(rows.dtypes)[order]
    copied = rows.select(*keys, order, F.col(time).alias("tempora_t"), F.col(x).cast("double").alias("tempora_x"), F.col(y).cast("double").alias("tempora_y"))
    return fold(copied, keys, [order], [order, "tempora_t", "tempora_x", "tempora_y"], list, step, f"{order} {kind}, x double, y double, vx double, vy double")


def coast(rows: DataFrame, keys: list[str], order: str, x: str, y: str, alpha: float = 0.5, fall: float = 1.0) -> DataFrame:
    """(*keys, order, x, y): a plain tracker of one object in pixels, folded over its rows in order.

    Speed is an exponential mean of the moves; a row without a position moves on by the speed, which then gains `fall`
    downwards. Rows before the first position have none.
    """

    def step(s: list, at, a, b):
        px, py, vx, vy = s
        if a is not None:
            if px is not None:
                vx, vy = (a - px) * alpha + vx * (1 - alpha), (b - py) * alpha + vy * (1 - alpha)
            px, py = a, b
        elif px is not None:
            px, py, vy = px + vx, py + vy, vy + fall
        s[:] = px, py, vx, vy
        return [(at, px, py)]

    kind = dict(rows.dtypes)[order]
    copied = rows.select(*keys, order, F.col(x).cast("double").alias("tempora_x"), F.col(y).cast("double").alias("tempora_y"))
    return fold(copied, keys, [order], [order, "tempora_x", "tempora_y"], lambda: [None, None, 0.0, 0.0], step, f"{order} {kind}, x double, y double")
