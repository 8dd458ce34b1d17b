"""Reports over analysis results: roll-ups against ground truth, best rows, event scores (the last an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.config import DEFAULT


def rollup(runs: DataFrame, keys: list[str], count: str = "throw_count", truth_total: int = DEFAULT.truth_total, truth_streak: int = DEFAULT.truth_streak) -> DataFrame:
    """Per key: sorted run lengths, their total and longest (0 without runs), number, and errors against the truth."""
    out = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(count)).alias("runs"))
    total = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = out.select(*keys, "runs", total.alias("total_throws"), F.coalesce(F.array_max("runs"), F.lit(0)).cast("bigint").alias("max_streak"), F.size("runs").alias("run_count"))
    return out.withColumn("total_error", F.abs(F.col("total_throws") - truth_total)).withColumn("max_error", F.abs(F.col("max_streak") - truth_streak)).withColumn("combined_error", F.col("total_error") + F.col("max_error"))


def best(report: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    return report.orderBy("combined_error", *keys).limit(k)


def folder_parts(path):
    """struct(video, model, resolution) of a folder `video_model_resolution`; null unless it has the three parts."""
    found = r"^(.*)_([^_]*)_([^_]*)$"
    ok = path.rlike(found)
    part = lambda i: F.regexp_extract(path, found, i)
    return F.when(ok, F.struct(part(1).alias("video"), F.upper(part(2)).alias("model"), part(3).cast("int").alias("resolution")))


def throughput(results: DataFrame) -> DataFrame:
    """fps: all frames over wall seconds, one decimal; a failed run (null seconds) has none."""
    return results.withColumn("fps", F.round(F.when(F.col("total_time") > 0, F.col("frame_count") / F.col("total_time")), 1))


def event_scores(truth: DataFrame, found: DataFrame, within: float) -> DataFrame:
    """Per video: events, matches within a time and F1, each true event matched by its nearest (an extension)."""
    pair = truth.alias("t").join(found.alias("f"), (F.col("t.video_id") == F.col("f.video_id")) & (F.floor(F.col("t.timestamp") / within) - F.floor(F.col("f.timestamp") / within)).between(-1, 1) & (F.abs(F.col("t.timestamp") - F.col("f.timestamp")) <= within))
    hit = pair.groupBy(F.col("t.video_id").alias("video_id"), F.col("t.timestamp").alias("timestamp")).agg(F.min_by("f.timestamp", F.abs(F.col("t.timestamp") - F.col("f.timestamp"))).alias("at"))
    hits = hit.groupBy("video_id").agg(F.countDistinct("at").alias("hits"))
    n = truth.groupBy("video_id").agg(F.count("*").alias("n_true")).join(found.groupBy("video_id").agg(F.count("*").alias("n_found")), "video_id", "full")
    return n.join(hits, "video_id", "left").na.fill(0).withColumn("f1", F.when(F.col("n_true") + F.col("n_found") > 0, 2 * F.col("hits") / (F.col("n_true") + F.col("n_found"))).otherwise(0.0))


def interval_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per pair of overlapping segments of a video, their intersection over union (an extension)."""
    x, y = a.alias("a"), b.alias("b")
    inter = F.least("a.end_time", "b.end_time") - F.greatest("a.start_time", "b.start_time")
    joined = x.join(y, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.start_time") <= F.col("b.end_time")) & (F.col("b.start_time") <= F.col("a.end_time")))
    union = F.greatest("a.end_time", "b.end_time") - F.least("a.start_time", "b.start_time")
    return joined.select(F.col("a.video_id").alias("video_id"), F.col("a.segment_id").alias("a_id"), F.col("b.segment_id").alias("b_id"), F.when(union > 0, inter / union).otherwise(1.0).alias("iou"))
