"""Runs: sessions of events less than max_gap apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT


def runs(events: DataFrame, keys: list[str], time: str = "timestamp", max_gap: float | Column = DEFAULT.run_gap, min_events: int = DEFAULT.run_min, bucket: float | None = None, count: str = "throw_count") -> DataFrame:
    """(*keys, run_id, start_time, end_time, count): islands split where a gap is max_gap or more, of min_events or more.

    Two levels, so that a key with a large part of all rows is no single task: islands within (key, time bucket), which
    are sorted and cut in parallel, then the few islands of a key. Gaps are plain subtractions of the time column, and
    `max_gap` may be a column that is constant within a key.
    """
    gap = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    width = bucket if bucket is not None else (3600 * max_gap if not isinstance(max_gap, Column) else None)
    rows = events.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("t"), gap.alias("gap"))
    part = [*keys] if width is None else [*keys, "bucket"]
    if width is not None:
        rows = rows.withColumn("bucket", F.floor(F.col("t") / F.lit(width)))
    order = Window.partitionBy(*part).orderBy("t")
    rows = rows.withColumn("island", F.sum(F.when(F.col("t") - F.lag("t").over(order) >= F.col("gap"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*part, "island").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"), F.first("gap").alias("gap"))
    order = Window.partitionBy(*keys).orderBy("s", "e")
    islands = islands.withColumn("run", F.sum(F.when(F.col("s") - F.lag("e").over(order) >= F.col("gap"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy(*keys, "run").agg(F.min("s").alias("start_time"), F.max("e").alias("end_time"), F.sum("n").alias(count)).where(F.col(count) >= min_events)
    return whole.withColumn("run_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start_time"))).select(*keys, "run_id", "start_time", "end_time", count)


def runs_by_session_window(events: DataFrame, keys: list[str], time: str, max_gap_micros: int, min_events: int = DEFAULT.run_min) -> DataFrame:
    """The same islands by session_window, whose gap is inclusive: one microsecond less keeps gaps of max_gap apart."""
    window = F.session_window(time, f"{max_gap_micros - 1} microseconds")
    return events.groupBy(*keys, window.alias("w")).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("n_events")).where(F.col("n_events") >= min_events).drop("w")


def adaptive_gap(events: DataFrame, keys: list[str], time: str, least: float, factor: float = 3.0) -> DataFrame:
    """(*keys, gap): the larger of `least` and factor times the median distance between events (an extension)."""
    delta = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return events.withColumn("delta", delta).groupBy(*keys).agg(F.greatest(F.lit(float(least)), factor * F.coalesce(F.median("delta"), F.lit(0.0))).alias("gap"))


def run_statistics(found: DataFrame, keys: list[str], count: str = "throw_count") -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").alias("run_count"), F.sum(count).alias("total"), F.max(count).alias("max_streak"), F.avg(count).alias("mean_count"), F.median(count).alias("median_count"))
