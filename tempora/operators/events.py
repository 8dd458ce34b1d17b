"""Throw and peak events of tracks within segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT, Settings
from tempora.functions import peaks

_KINDS = {"throw": 0, "peak": 1}


def segment_points(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points with the segment they lie in, both ends included. Segments of a video are few and join by video."""
    s = segments.select("video_id", "segment_id", "start_time", "end_time")
    return points.join(s, "video_id").where(F.col("timestamp").between(F.col("start_time"), F.col("end_time"))).drop("start_time", "end_time")


def _track_events(settings: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_idx", "ascending")])
        n = table.num_rows
        found: list[tuple[float, float, str, int]] = []
        if n >= settings.min_points:
            t = table.column("timestamp").to_numpy()
            y = table.column("pos_y").to_numpy()
            stamp = np.rint(t * 1e4) / 1e4
            found += [(stamp[i], settings.event_confidence, "throw", 0) for i in peaks.find(y, settings.prominence)]
            found += [(stamp[i], settings.event_confidence, "peak", 1) for i in peaks.find(-y, settings.prominence, settings.width)]
            for i, step in ((0, 2), (n - 1, 3)):
                if y[i] < settings.edge_y and not any(kind == "peak" and abs(at - t[i]) < settings.edge_seconds for at, _, kind, _ in found):
                    found.append((stamp[i], settings.edge_confidence, "peak", step))
        cols = list(zip(*found)) if found else [[]] * 4
        head = [pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in ("video_id", "segment_id", "track_id")]
        return pa.table([*head, pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["video_id", "segment_id", "track_id", "timestamp", "confidence", "event_type", "step"])

    return run


def events(points: DataFrame, segments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(video_id, segment_id, event_id, timestamp, track_id, confidence, event_type).

    Throws are maxima of y (y grows downwards), peaks minima of a least width; a track that starts or ends in a segment
    near the top edge has a peak there unless one is close. event_id orders a segment's events by time, then track,
    then the step that found them.
    """
    inside = segment_points(points, segments).select("video_id", "segment_id", "track_id", "frame_idx", "timestamp", "pos_y")
    found = inside.groupBy("video_id", "segment_id", "track_id").applyInArrow(_track_events(settings), "video_id string, segment_id int, track_id int, timestamp double, confidence double, event_type string, step int")
    return numbered(found, ["timestamp", "track_id", "step"], "event_id").drop("step")


def numbered(found: DataFrame, order: list[str], place: str) -> DataFrame:
    """The place of each event in its segment, from 0."""
    return found.withColumn(place, F.row_number().over(Window.partitionBy("video_id", "segment_id").orderBy(*order)) - 1)
