"""Column helpers: rounding, clamping, guarded division, frames and times, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: Column) -> Column:
    """Four decimals, ties to even on the scaled value, as NumPy rounds."""
    return F.rint(c * 1e4) / 1e4


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rate(count: Column, duration: Column) -> Column:
    """count / duration, 0 where the duration isn't positive."""
    return F.when(duration > 0, count / duration).otherwise(F.lit(0.0))


def rate_label(count: Column, duration: Column) -> Column:
    """The rate with two decimals, hundredths rounded half up."""
    hundredths = F.floor(count / duration * 100 + 0.5) / 100
    return F.when(duration > 0, F.concat(F.format_string("%.2f", hundredths), F.lit(" t/s"))).otherwise(F.lit("0 t/s"))


def frame_of(seconds: Column, fps: Column) -> Column:
    """The frame at a time: truncated."""
    return (seconds * fps).cast("int")


def as_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def holds(text: Column, part: str) -> Column:
    """Whether a text holds a part, as it is."""
    return text.contains(part)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session's zone."""
    return F.expr(f"CAST(datediff(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400000000 + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")


def centre_and_size(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre and size of a pixel box."""
    return {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def clipped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """The whole-pixel box inside the frame; `empty` where nothing is left."""
    a, b = F.greatest(F.lit(0), x1.cast("int")), F.greatest(F.lit(0), y1.cast("int"))
    c, d = F.least(width, x2.cast("int")), F.least(height, y2.cast("int"))
    return {"x1": a, "y1": b, "x2": c, "y2": d, "empty": (c <= a) | (d <= b)}


def aspect(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(0.0)


def noise_gate(x1: Column, y1: Column, x2: Column, y2: Column, full_scan: Column | bool = False) -> Column:
    """Large and nearly square: area over 800 (2500 in a full scan) and aspect strictly between 0.8 and 1.2."""
    w, h = x2.cast("int") - x1.cast("int"), y2.cast("int") - y1.cast("int")
    least = F.when(full_scan if isinstance(full_scan, Column) else F.lit(full_scan), 2500).otherwise(800)
    return (w * h > least) & (aspect(w, h) > 0.8) & (aspect(w, h) < 1.2)


def contour_gate(area: Column, w: Column, h: Column, perimeter: Column, edge: Column, min_area: float = 400, scale: float = 1.0, min_circularity: float = 0.65) -> Column:
    """Shape gates of the signature detector on descriptor columns."""
    roundness = F.when(perimeter != 0, 4 * 3.141592653589793 * area / (perimeter * perimeter))
    return (area >= min_area * scale * scale) & (aspect(w, h) > 0.7) & (aspect(w, h) < 1.4) & F.coalesce(roundness >= min_circularity, F.lit(False)) & edge


def in_reticle(cx: Column, cy: Column, rx: Column, ry: Column, reach: float = 50) -> Column:
    return (F.abs(cx - rx) < reach) & (F.abs(cy - ry) < reach)


def class_gate(class_id: Column, allowed: list[int] | None, targets: list[int] | None = (32,)) -> Column:
    """Allowed classes; None falls back to the targets, and None there lets all through."""
    wanted = allowed if allowed is not None else targets
    return F.lit(True) if wanted is None else class_id.isin(list(wanted))


def mosaic_box(box: dict[str, Column], crops: Column, cell: Column, grid: Column) -> Column:
    """The number of the crop whose mosaic cell holds a box's centre; null for an empty cell."""
    col = F.floor((box["x1"] + box["x2"]) / 2 / cell)
    row = F.floor((box["y1"] + box["y2"]) / 2 / cell)
    at = (row * grid + col).cast("int")
    return F.when(at < crops, at)


def mosaic_grid(crops: Column, size: Column) -> dict[str, Column]:
    grid = F.ceil(F.sqrt(crops.cast("double"))).cast("int")
    return {"grid": grid, "cell": F.expr("int(0)") + F.floor(size / grid).cast("int")}
