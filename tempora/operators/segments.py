"""Activity segments: islands of frames with enough active tracks, bridging short gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT
from tempora.functions.scalar import round4


def segments(features: DataFrame, min_on: float = DEFAULT.min_on, min_off: float = DEFAULT.min_off, min_active: int = DEFAULT.min_active, confidence: float = DEFAULT.segment_confidence) -> DataFrame:
    """(video_id, segment_id, start_time, end_time, confidence) of dense frame features.

    An island is cut where more than G = int(min_off * frames / last timestamp) frames in a row aren't active (5 if no
    time passes). An island that is cut ends one frame before its last active one; if that is before the first frame,
    the end wraps to the last frame. Only an island that reaches within G of the end of the video ends where it ends.
    """
    whole = features.groupBy("video_id").agg(F.count("*").alias("frames"), F.max("timestamp").alias("last_ts"))
    order = Window.partitionBy("video_id").orderBy("frame_idx")
    rows = features.select("video_id", F.col("frame_idx"), "timestamp", "num_active_tracks", F.lag("timestamp").over(order).alias("before"))
    rows = rows.withColumn("position", F.row_number().over(order) - 1).where(F.col("num_active_tracks") >= min_active)
    rows = rows.join(whole, "video_id").withColumn("allowed", F.when(F.col("last_ts") > 0, (F.lit(min_off) * (F.col("frames") / F.col("last_ts"))).cast("int")).otherwise(5))
    order = Window.partitionBy("video_id").orderBy("position")
    cut = F.col("position") - F.lag("position").over(order) - 1 > F.col("allowed")
    rows = rows.withColumn("island", F.sum(F.when(cut, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("video_id", "island").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"), F.max("position").alias("last"), F.max_by("before", "position").alias("before"), F.first("frames").alias("frames"), F.first("last_ts").alias("last_ts"), F.first("allowed").alias("allowed"))
    trailing = F.col("frames") - 1 - F.col("last")
    end = F.when(trailing <= F.col("allowed"), F.col("e")).when(F.col("last") == 0, F.col("last_ts")).otherwise(F.col("before"))
    found = found.withColumn("end", end).where(F.col("end") - F.col("s") >= min_on)
    found = found.withColumn("segment_id", F.row_number().over(Window.partitionBy("video_id").orderBy("s")) - 1)
    return found.select("video_id", "segment_id", round4(F.col("s")).alias("start_time"), round4(F.col("end")).alias("end_time"), F.lit(confidence).alias("confidence"))
