"""The whole analysis: detections -> tracks -> filled tracks -> features -> segments -> events -> runs -> documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.config import DEFAULT, Settings
from tempora.operators.events import events
from tempora.operators.features import frame_features
from tempora.operators.gapfill import fill_gaps
from tempora.operators.history import segment_totals
from tempora.operators.runs import runs
from tempora.operators.segments import segments
from tempora.operators.tracking import track


@dataclass
class Analysis:
    videos: DataFrame
    points: DataFrame
    features: DataFrame
    segments: DataFrame
    events: DataFrame
    runs: DataFrame


def analyse(detections: DataFrame, videos: DataFrame, settings: Settings = DEFAULT, test_mode: bool = False) -> Analysis:
    """Every stage as a lazy DataFrame keyed by video. Features span all frames, in test mode too; runs are made of a
    segment's peaks, so they never cross segments."""
    points = fill_gaps(track(detections, videos, settings, test_mode=test_mode), ["video_id", "track_id"], settings.max_fill_gap, vertex_window=settings.vertex_window).drop("is_filled")
    features = frame_features(points, videos)
    found = segments(features, settings.min_on, settings.min_off, settings.min_active, settings.segment_confidence)
    marks = events(points, found, settings)
    streaks = runs(marks.where("event_type = 'peak'"), ["video_id", "segment_id"], "timestamp", settings.run_gap, settings.run_min)
    return Analysis(videos, points, features, found, marks, streaks)


def documents(a: Analysis) -> DataFrame:
    """One nested row a video, in the shape of the JSON document."""
    sorted_list = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    run_cols = ("start_time", "end_time", "throw_count")
    per_segment = a.segments
    throws = a.events.groupBy("video_id", "segment_id").agg(sorted_list("event_id", "timestamp", "track_id", "confidence", "event_type").alias("e"))
    throws = throws.select("video_id", "segment_id", F.transform("e", lambda x: F.struct(x["timestamp"].alias("timestamp"), x["track_id"].alias("track_id"), x["confidence"].alias("confidence"), x["event_type"].alias("event_type"))).alias("throws"))
    streaks = a.runs.groupBy("video_id", "segment_id").agg(sorted_list(*run_cols).alias("runs"))
    totals = segment_totals(a.events, ["video_id", "segment_id"]).select("video_id", "segment_id", "total_throws", "total_peaks")
    for other in (throws, streaks, totals):
        per_segment = per_segment.join(other, ["video_id", "segment_id"], "left")
    segment = F.struct("start_time", "end_time", "confidence").alias("segment")
    part = F.struct("segment_id", segment, F.coalesce("throws", F.array()).alias("throws"), F.coalesce("runs", F.array()).alias("runs"), F.coalesce("total_throws", F.lit(0)).cast("int").alias("total_throws"), F.coalesce("total_peaks", F.lit(0)).cast("int").alias("total_peaks"))
    nested = per_segment.groupBy("video_id").agg(F.sort_array(F.collect_list(part)).alias("s")).select("video_id", F.transform("s", lambda x: x.dropFields("segment_id")).alias("segments"))
    point = sorted_list("frame_idx", "timestamp", "pos_x", "pos_y", "confidence", "is_interpolated")
    tracks = a.points.groupBy("video_id", "track_id").agg(point.alias("points")).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(F.col("track_id").alias("id"), "points"))).alias("tracks"))
    every_run = a.runs.groupBy("video_id").agg(sorted_list(*run_cols).alias("runs"))
    out = a.videos.select("video_id", F.struct("fps", "width", "height", "frame_count", "duration").alias("video_metadata"))
    for other in (nested, tracks, every_run):
        out = out.join(other, "video_id", "left")
    return out
