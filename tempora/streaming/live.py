"""Streams: runs of an event stream, live peaks of tracked points, live tracking, command triggers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora import schemas
from tempora.config import DEFAULT, Settings
from tempora.functions import peaks
from tempora.operators.commands import commands
from tempora.operators.folds import fold
from tempora.operators.runs import runs_by_session_window
from tempora.operators.tracking import Tracker


def stream_runs(events: DataFrame, keys: list[str], time: str, max_gap_micros: int, watermark: str = "1 day", min_events: int = DEFAULT.run_min) -> DataFrame:
    """Runs of a stream whose time column is a timestamp. Events later than the watermark are dropped; in append mode a
    run appears once the watermark has passed its end."""
    return runs_by_session_window(events.withWatermark(time, watermark), keys, time, max_gap_micros, min_events)


def _live_peaks(history: int, prominence: float, least: int, flat: bool, key_type):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ys, last, count = pickle.loads(state.get[0]) if state.exists else ([], [], 0.0, 0)
        found = []
        rows = pd.concat(list(frames)).sort_values(["t", "y"])
        for t, y in zip(rows["t"], rows["y"]):
            ts, ys = [*ts, t][-history:], [*ys, y][-history:]
            if len(ts) >= least:
                for i in peaks.find(-np.array(ys), prominence, flat=flat):
                    if ts[i] > last:
                        last, count = ts[i], count + 1
                        found.append((key[0], last, count))
        state.update((pickle.dumps((ts, ys, last, count)),))
        yield pd.DataFrame(found, columns=["key", "peak_time", "peak_count"]).astype({"key": key_type, "peak_time": "float64", "peak_count": "int64"})

    return run


def live_peaks(points: DataFrame, key: str, time: str, y: str, history: int = DEFAULT.live_history, prominence: float = DEFAULT.live_prominence, least: int = DEFAULT.min_points, flat: bool = True) -> DataFrame:
    """(key, peak_time, peak_count) as they are found: minima of y within the last `history` points of each key, those of
    several equal points only if `flat`.

    State is bounded by `history`. Points of a micro-batch are taken in order of time; only peaks later than the last
    one counted count, so one that becomes prominent after a newer one was counted is lost, as live counting must.
    """
    rows = points.select(F.col(key).alias("key"), F.col(time).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    kind = dict(rows.dtypes)["key"]
    made = _live_peaks(history, prominence, least, flat, {"bigint": "int64", "int": "int32"}.get(kind, "object"))
    return rows.groupBy("key").applyInPandasWithState(made, f"key {kind}, peak_time double, peak_count long", "state binary", "append", GroupStateTimeout.NoTimeout)


def _live_tracking(settings: Settings):
    names = [x.split()[0] for x in schemas.TRACK_POINTS.split(", ")]
    kinds = {"video_id": "object", "track_id": "int32", "frame_idx": "int32", "timestamp": "float64", "pos_x": "float64", "pos_y": "float64", "confidence": "float64", "is_interpolated": "bool"}

    def run(key, frames, state: GroupState):
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(settings, max_distance=settings.live_max_distance, gravity=settings.live_gravity)
        rows, out = pd.concat(list(frames)).sort_values(["frame_idx", "det_idx"]), []
        for frame, g in rows.groupby("frame_idx", sort=True):
            boxes = g.loc[g["x1"].notna(), ["x1", "y1", "x2", "y2", "confidence"]].to_numpy(float)
            out += [(key[0], *p) for p in tracker.step(int(frame), float(g["timestamp"].iloc[0]), boxes, int(g["width"].iloc[0]), int(g["height"].iloc[0]))]
        state.update((pickle.dumps(tracker),))
        yield pd.DataFrame(out, columns=names).astype(kinds)

    return run


def live_tracking(detections: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Track points of a detection stream (a row with null boxes stands for an empty frame); a video's state is its tracker."""
    return detections.groupBy("video_id").applyInPandasWithState(_live_tracking(settings), schemas.TRACK_POINTS, "state binary", "append", GroupStateTimeout.NoTimeout)


def triggers(transcripts: DataFrame) -> DataFrame:
    """Only transcripts that hold a command, with its flags."""
    return commands(transcripts).where("ball or background or reset")


def audio_chunks(rows: DataFrame, keys: list[str], order: str, size: str, limit: float) -> DataFrame:
    """Numbers the buffers of an audio stream's pieces: a buffer is handed on, whole, once it holds more than `limit`."""

    def step(state: list, at, s):
        chunk = state[0]
        state[1] += s
        if state[1] > limit:
            state[:] = [chunk + 1, 0.0]
        return [(at, chunk)]

    kind = dict(rows.dtypes)[order]
    return fold(rows.withColumn(size, F.col(size).cast("double")), keys, [order], [order, size], lambda: [0, 0.0], step, f"{order} {kind}, chunk int")
