"""Per-frame metrics of the overlay: counts so far, statistics of runs done, the current run, flags."""

from __future__ import annotations

import bisect
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT
from tempora.operators.folds import fold


#: Marks of one moment are taken in this order: a run holds its first throw and its last frame.
_BEGIN, _THROW, _FRAME, _END = range(4)


class _Video:
    """What a frame needs of all that came before it."""

    def __init__(self):
        self.throws = self.lit = self.segments = self.total = 0
        self.done: list[int] = []  # throw counts of completed runs, sorted
        self.open: dict[int, int] = {}  # run order -> throws before its start

    def median(self) -> float:
        n = len(self.done)
        return (self.done[(n - 1) // 2] + self.done[n // 2]) / 2 if n else 0.0


def _step(v: _Video, kind: int, what: str, number: int | None, count: int | None, at) -> list[tuple]:
    if kind == _FRAME:
        run = min(v.open, default=-1)
        return [(number, at, v.throws, v.total / len(v.done) if v.done else 0.0, v.median(), run, v.throws - v.open[run] if run >= 0 else 0, v.lit, v.segments > 0)]
    sign = 1 if kind != _END else -1
    if what == "throw":
        v.throws += 1
    elif what == "light":
        v.lit += sign
    elif what == "segment":
        v.segments += sign
    elif kind == _BEGIN:
        v.open[number] = v.throws
    else:
        v.open.pop(number, None)
        bisect.insort(v.done, count)
        v.total += count
    return []


def overlay(frames: DataFrame, events: DataFrame, runs: DataFrame, segments: DataFrame, flash: float = DEFAULT.flash_seconds) -> DataFrame:
    """frames(video_id, frame_idx, timestamp) with the drawn metrics.

    Frames and marks of a video meet once, sorted by time, and stream through one pass; memory holds the counts of the
    runs done. The current run is the first, in order, that holds the frame; a run that ends right at the frame isn't
    completed. Frames before any mark have zeros.
    """
    time = dict(frames.dtypes)["timestamp"]

    def marks(rows: DataFrame, at, kind: int, what: str, number=None, count=None) -> DataFrame:
        null = F.lit(None)
        return rows.select("video_id", at.cast(time).alias("at"), F.lit(kind).alias("kind"), F.lit(what).alias("what"), (null if number is None else number).cast("long").alias("number"), (null if count is None else count).cast("long").alias("count"))

    start, end, stamp = F.col("start_time"), F.col("end_time"), F.col("timestamp")
    every = [
        marks(frames, stamp, _FRAME, "frame", F.col("frame_idx")),
        marks(events.where("event_type = 'throw'"), stamp, _THROW, "throw"),
        marks(events, stamp, _THROW, "light"), marks(events, stamp + flash, _END, "light"),
        marks(runs, start, _BEGIN, "run", F.col("run_order")), marks(runs, end, _END, "run", F.col("run_order"), F.col("throw_count")),
        marks(segments, start, _BEGIN, "segment"), marks(segments, end, _END, "segment"),
    ]
    both = reduce(DataFrame.unionByName, every)
    kind = dict(frames.dtypes)["frame_idx"]
    out = f"frame_idx {kind}, timestamp {time}, session_throws long, mean_throws double, median_throws double, current_run int, current_run_throws long, flashing int, in_segment boolean"
    return fold(both, ["video_id"], ["at", "kind"], ["kind", "what", "number", "count", "at"], _Video, _step, out)


def tail(points: DataFrame, keys: list[str], order: str, columns: list[str], length: int = 20) -> DataFrame:
    """points plus `tail`, the last `length` points up to and with each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    return points.withColumn("tail", F.collect_list(F.struct(*columns)).over(w))


def rolling_mean(rows: DataFrame, keys: list[str], order: str, column: str, length: int = DEFAULT.fps_window) -> DataFrame:
    return rows.withColumn("rolling_mean", F.avg(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)))


def ema(rows: DataFrame, keys: list[str], order: str, column: str, alpha: float) -> DataFrame:
    """(*keys, ema): the exponential mean of a series, folded in order; it starts at the first value."""

    def step(state: list, v):
        state[:] = [v] if not state else [state[0] * (1 - alpha) + v * alpha]
        return ()

    return fold(rows.withColumn(column, F.col(column).cast("double")), keys, [order], [column], list, step, "ema double", lambda state: [tuple(state)])
