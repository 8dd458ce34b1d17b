"""Object signatures: registered samples, merged vectors, histograms of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_CLASS_ID = 100


def merge(samples: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(*keys, pos, mean): element-wise means, as rows; sums are combined before the shuffle whatever the vectors' length."""
    return samples.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def as_vectors(merged: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    return merged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("s")).select(*keys, F.transform("s", lambda x: x[value]).alias("merged"))


def min_max(vector: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """Stretched to low..high; a flat vector becomes low."""
    least, most = F.array_min(vector), F.array_max(vector)
    return F.transform(vector, lambda x: F.when(most > least, low + (x - least) * (high - low) / (most - least)).otherwise(F.lit(low)))


def hue_histogram(pixels: DataFrame, keys: list[str], hue: str = "hue", saturation: str | None = "saturation", bins: int = 36, span: float = 180.0, least: float = 30.0) -> DataFrame:
    """(*keys, bin, n): counts of hues in [0, span) of pixels more saturated than `least`."""
    held = pixels.where((F.col(hue) >= 0) & (F.col(hue) < span))
    if saturation is not None:
        held = held.where(F.col(saturation) > least)
    return held.groupBy(*keys, F.floor(F.col(hue) * bins / span).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def stretched(histogram: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Adds `level`, counts stretched to 0..255 over all bins, empty ones included."""
    w = Window.partitionBy(*keys)
    least = F.when(F.count("*").over(w) < bins, F.lit(0)).otherwise(F.min("n").over(w))
    most = F.max("n").over(w)
    return histogram.withColumn("level", F.when(most > least, (F.col("n") - least) * 255.0 / (most - least)).otherwise(0.0))


def register(samples: DataFrame, known: DataFrame) -> DataFrame:
    """samples(label, ...) with class ids: a known label keeps its own, new ones go on from the highest, by label."""
    top = known.agg(F.coalesce(F.max("class_id") + 1, F.lit(FIRST_CLASS_ID)).alias("next"))
    fresh = samples.select("label").distinct().join(known.select("label"), "label", "left_anti")
    numbered = fresh.withColumn("rank", F.row_number().over(Window.orderBy("label")) - 1).crossJoin(F.broadcast(top)).select("label", (F.col("next") + F.col("rank")).cast("int").alias("class_id"))
    return samples.join(known.select("label", "class_id").unionByName(numbered), "label")


def registration_info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.first("class_id").alias("class_id"), F.count("*").alias("sample_count"), F.bool_or(F.col("color").isNotNull()).alias("has_color"), F.bool_or(F.col("texture").isNotNull()).alias("has_texture"))


# pixels


def lbp(gray: np.ndarray) -> np.ndarray:
    """Local binary patterns: bit k is set where the k-th neighbour, clockwise from the top left, isn't darker; 0 at borders."""
    out = np.zeros(gray.shape, np.uint8)
    h, w = gray.shape
    if h < 3 or w < 3:
        return out
    centre = gray[1:-1, 1:-1]
    for k, (dy, dx) in enumerate([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]):
        out[1:-1, 1:-1] |= (gray[dy : dy + h - 2, dx : dx + w - 2] >= centre).astype(np.uint8) << k
    return out


def texture_histogram(gray: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    codes = lbp(gray)
    counts = np.bincount(codes[mask > 0] if mask is not None else codes.ravel(), minlength=256).astype(np.float32)
    return counts / (counts.sum() + 1e-6)


def pixel_hue_histogram(hue: np.ndarray, saturation: np.ndarray, mask: np.ndarray | None = None, bins: int = 36) -> np.ndarray:
    keep = (saturation > 30) & ((mask > 0) if mask is not None else True)
    counts = np.bincount((hue[keep].astype(np.int64) * bins) // 180, minlength=bins)[:bins].astype(np.float32)
    spread = counts.max() - counts.min()
    return (counts - counts.min()) * 255 / spread if spread else np.zeros_like(counts)


def background_ratio(target: np.ndarray, background: np.ndarray) -> np.ndarray:
    ratio = target / (target + background + 1e-5)
    spread = ratio.max() - ratio.min()
    return (ratio - ratio.min()) * 255 / spread if spread else np.zeros_like(ratio)


def back_projection(hue: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Each pixel's histogram level, 0..255."""
    return histogram[(hue.astype(np.int64) * len(histogram)) // 180].clip(0, 255).astype(np.uint8)


def ellipse(height: int, width: int, share: float = 0.6) -> np.ndarray:
    """255 inside the ellipse around the middle with half axes of `share` of the box."""
    y, x = np.mgrid[:height, :width]
    a, b = max(1, int(width * share)), max(1, int(height * share))
    return np.where(((x - width // 2) / a) ** 2 + ((y - height // 2) / b) ** 2 <= 1, 255, 0).astype(np.uint8)
