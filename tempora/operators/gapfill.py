"""Filling gaps of tracks: straight lines, and a parabola for the height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.config import DEFAULT
from tempora.functions.scalar import round4


def _with_parabola(rows: DataFrame, points: list[tuple[Column, Column]]) -> DataFrame:
    """Adds a, b, c of the least-squares a t^2 + b t + c through (t, y) points; points with a null t are left out.

    Sums, determinants and quotients are columns of their own, which keeps the generated code small.
    """
    sums = {f"s{k}": sum((F.coalesce(_power(t, k), F.lit(0.0)) for t, _ in points), F.lit(0.0)) for k in range(5)}
    sums |= {f"r{k}": sum((F.coalesce(_power(t, k) * y, F.lit(0.0)) for t, y in points), F.lit(0.0)) for k in range(3)}
    rows = rows.withColumns(sums)

    def det(m):
        c = F.col
        return c(m[0][0]) * (c(m[1][1]) * c(m[2][2]) - c(m[1][2]) * c(m[2][1])) - c(m[0][1]) * (c(m[1][0]) * c(m[2][2]) - c(m[1][2]) * c(m[2][0])) + c(m[0][2]) * (c(m[1][0]) * c(m[2][1]) - c(m[1][1]) * c(m[2][0]))

    whole = [["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]]
    right = ["r2", "r1", "r0"]
    rows = rows.withColumns({"d": det(whole)} | {f"d{k}": det([[right[i] if j == k else whole[i][j] for j in range(3)] for i in range(3)]) for k in range(3)})
    return rows.withColumns({n: F.when(F.col("d") != 0, F.col(f"d{k}") / F.col("d")) for k, n in enumerate("abc")}).drop("d", "d0", "d1", "d2", *sums)


def _power(t: Column, k: int) -> Column:
    out = F.when(t.isNotNull(), F.lit(1.0))
    for _ in range(k):
        out = out * t
    return out


def fill_gaps(points: DataFrame, keys: list[str], max_gap: int = DEFAULT.max_fill_gap, quadratic: bool = True, vertex_window: float = DEFAULT.vertex_window) -> DataFrame:
    """points plus the missing ones between neighbours 2 to max_gap frames apart; `is_filled` tells them.

    Position and confidence are linear. The height is a least-squares parabola through the two ends and their
    neighbours where there are three points or more; close to its top (a least y above both ends) it snaps to it.
    Times are taken from the gap's start, which keeps the fit well-conditioned. Filled points aren't `interpolated`,
    a word kept for the tracker's own predictions.
    """
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    near = {f"{c}_{n}": F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) for c, n, k in [("timestamp", "p", 1), ("pos_y", "p", 1), ("timestamp", "n", -1), ("pos_y", "n", -1), ("pos_x", "n", -1), ("confidence", "n", -1), ("frame_idx", "n", -1), ("timestamp", "m", -2), ("pos_y", "m", -2)]}
    rows = points.select("*", *[c.alias(n) for n, c in near.items()]).withColumn("gap", F.col("frame_idx_n") - F.col("frame_idx"))
    gaps = rows.where((F.col("gap") > 1) & (F.col("gap") <= max_gap))
    t1 = F.col("timestamp")
    at = [(F.col(f"timestamp{n}") - t1, F.col(f"pos_y{n}")) for n in ("_p", "", "_n", "_m")]
    three = F.col("timestamp_p").isNotNull() | F.col("timestamp_m").isNotNull()
    gaps = _with_parabola(gaps, at).withColumn("a", F.when(three, F.col("a")))
    gaps = gaps.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("gap") - 1))).withColumn("alpha", F.col("j") / F.col("gap"))

    def line(col: str) -> Column:
        return F.col(col) + (F.col(f"{col}_n") - F.col(col)) * F.col("alpha")

    t = line("timestamp") - t1
    curve = (F.col("a") * t + F.col("b")) * t + F.col("c")
    top_t = F.when(F.abs("a") > DEFAULT.min_curvature, -F.col("b") / (2 * F.col("a")))
    top_y = (F.col("a") * top_t + F.col("b")) * top_t + F.col("c")
    step = (F.col("timestamp_n") - t1) / F.col("gap")
    snap = (F.abs(t - top_t) <= step * vertex_window) & (top_y < F.col("pos_y")) & (top_y < F.col("pos_y_n"))
    y = F.when(F.col("a").isNull() | F.lit(not quadratic), line("pos_y")).when(F.coalesce(snap, F.lit(False)), top_y).otherwise(curve)
    new = {"frame_idx": (F.col("frame_idx") + F.col("j")).cast("int"), "timestamp": round4(line("timestamp")), "pos_x": round4(line("pos_x")), "pos_y": round4(y), "confidence": round4(line("confidence")), "is_interpolated": F.lit(False)}
    columns = points.columns
    filled = gaps.select(*[(new[x] if x in new else F.col(x)).alias(x) for x in columns], F.lit(True).alias("is_filled"))
    return points.withColumn("is_filled", F.lit(False)).unionByName(filled)
