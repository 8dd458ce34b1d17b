"""Velocities and dense per-frame features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def velocities(points: DataFrame, keys: list[str], order: str = "frame_idx", time: str = "timestamp", y: str = "pos_y") -> DataFrame:
    """Adds vy, the change of y over that of time since the previous point; null for a first point or no time passed."""
    w = Window.partitionBy(*keys).orderBy(order)
    dt = F.col(time) - F.lag(time).over(w)
    return points.withColumn("vy", F.when(dt > 0, (F.col(y) - F.lag(y).over(w)) / dt))


def frame_grid(videos: DataFrame) -> DataFrame:
    """One row a frame: video_id, frame_idx, timestamp (not rounded)."""
    rows = videos.where("frame_count > 0").select("video_id", "fps", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1)).alias("frame_idx"))
    return rows.select("video_id", "frame_idx", (F.col("frame_idx") / F.col("fps")).alias("timestamp"))


def frame_features(points: DataFrame, videos: DataFrame) -> DataFrame:
    """One row for every frame. Every track with a point counts, whatever its state; the spread is the population's."""
    found = velocities(points, ["video_id", "track_id"]).groupBy("video_id", "frame_idx", "track_id").agg(F.max_by("vy", F.col("timestamp")).alias("vy"))
    per_frame = found.groupBy("video_id", "frame_idx").agg(F.count("*").cast("int").alias("n"), F.avg("vy").alias("mean"), F.stddev_pop("vy").alias("std"))
    out = frame_grid(videos).join(per_frame, ["video_id", "frame_idx"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("video_id", "frame_idx", "timestamp", n.alias("num_detections"), n.alias("num_active_tracks"), F.coalesce("mean", F.lit(0.0)).alias("mean_velocity_y"), F.coalesce("std", F.lit(0.0)).alias("std_velocity_y"))
