"""Local extrema with prominence and width: a linear grouped pass, and plain SQL for short series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import peaks


def extrema(signal: DataFrame, keys: list[str], order: str, y: str, prominence: float, width: float | None = None, sign: int = 1) -> DataFrame:
    """The rows of `signal` at maxima (sign 1) or minima (sign -1) of y within each key, in the given order.

    A series is one group: prominence depends on values arbitrarily far away. Series run in parallel.
    """
    columns = signal.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        at = peaks.find(sign * table.column(y).to_numpy(zero_copy_only=False).astype(float), prominence, width)
        return table.take(pa.array(at, pa.int64())).select(columns)

    return signal.groupBy(*keys).applyInArrow(run, signal.schema)


def extrema_sql(signal: DataFrame, keys: list[str], order: str, y: str, prominence: float, sign: int = 1) -> DataFrame:
    """The same by windows and a self-join; its work grows with the square of a series, so it is for short ones."""
    spark = signal.sparkSession
    key, inner = ", ".join(keys), ", ".join(f"in_{k}" for k in keys)
    named = ", ".join(f"in_{c} AS {c}" for c in signal.columns)
    columns = ", ".join(f"s.{c}" for c in signal.columns)
    signal.select(*[F.col(c).alias(f"in_{c}") for c in signal.columns]).createOrReplaceTempView("tempora_signal")
    on = lambda a, b: " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys)
    return spark.sql(f"""
        WITH s AS (SELECT {named}, row_number() OVER (PARTITION BY {inner} ORDER BY in_{order}) - 1 AS tempora_i, {sign} * in_{y} AS tempora_v FROM tempora_signal),
        c AS (SELECT *, sum(CASE WHEN tempora_v = pv THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY tempora_i) AS g FROM (SELECT *, lag(tempora_v) OVER (PARTITION BY {key} ORDER BY tempora_i) AS pv FROM s)),
        f AS (SELECT {key}, g, any_value(tempora_v) AS v, min(tempora_i) AS a, max(tempora_i) AS b FROM c GROUP BY {key}, g),
        m AS (SELECT *, (a + b) div 2 AS p FROM (SELECT *, lag(v) OVER (PARTITION BY {key} ORDER BY a) AS l, lead(v) OVER (PARTITION BY {key} ORDER BY a) AS r FROM f) WHERE l < v AND r < v),
        w AS (SELECT {", ".join("m." + k for k in keys)}, m.p, m.v, max(s.tempora_i) FILTER (WHERE s.tempora_v > m.v AND s.tempora_i < m.p) AS lo, min(s.tempora_i) FILTER (WHERE s.tempora_v > m.v AND s.tempora_i > m.p) AS hi FROM m JOIN s ON {on("m", "s")} GROUP BY {", ".join("m." + k for k in keys)}, m.p, m.v),
        h AS (SELECT {", ".join("w." + k for k in keys)}, w.p, w.v - greatest(min(s.tempora_v) FILTER (WHERE s.tempora_i <= w.p), min(s.tempora_v) FILTER (WHERE s.tempora_i >= w.p)) AS prominence
              FROM w JOIN s ON {on("w", "s")} AND s.tempora_i > coalesce(w.lo, -1) AND s.tempora_i < coalesce(w.hi, 9223372036854775807) GROUP BY {", ".join("w." + k for k in keys)}, w.p, w.v)
        SELECT {columns}, h.prominence FROM h JOIN s ON {on("h", "s")} AND h.p = s.tempora_i WHERE h.prominence >= {prominence}""")


def places(y, prominence: float, width: float | None = None) -> list[int]:
    return [int(i) for i in peaks.find(np.asarray(y, float), prominence, width)]


def edge_events(points: DataFrame, keys: list[str], peaks_found: DataFrame, time: str, y: str, order: str, below: float, apart: float, min_points: int = 5) -> DataFrame:
    """(*keys, time): first and last points of a series with y below a bound and no peak of the series less than `apart` away.

    The last point is held against a peak added for the first one too.
    """
    ends = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct(F.col(time).alias("t"), F.col(y).alias("y")), order).alias("first"), F.max_by(F.struct(F.col(time).alias("t"), F.col(y).alias("y")), order).alias("last")).where(F.col("n") >= min_points)

    def lone(side: str, found: DataFrame) -> DataFrame:
        rows = ends.select(*keys, F.col(f"{side}.t").alias("t"), F.col(f"{side}.y").alias("y")).where(F.col("y") < below)
        other = found.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(time).alias("o_t"))
        same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys] + [F.abs(F.col("o_t") - F.col("t")) < apart]
        for c in same[1:]:
            same[0] = same[0] & c
        return rows.join(other, same[0], "left_anti").select(*keys, F.col("t").alias(time))

    first = lone("first", peaks_found)
    last = lone("last", peaks_found.select(*keys, time).unionByName(first))
    return first.withColumn("edge", F.lit("first")).unionByName(last.withColumn("edge", F.lit("last")))
