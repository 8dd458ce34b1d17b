"""Users, sessions and their runs: upserts, inserts, history and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalar import rate


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with the last change of each key (by `order`, ties by all columns) put in place of its row or added.

    Keys without a change keep their row untouched: an anti join, not a rewrite by windows.
    """
    columns = current.columns
    newest = changes.withColumn("tempora_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), *columns))).where("tempora_rank = 1").select(*columns)
    return current.join(newest.select(key), key, "left_anti").select(*columns).unionByName(newest)


def session_key(*columns: str):
    """A deterministic key for a session: repeating an insert gives the same key."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def insert_session(sessions: DataFrame, events: DataFrame, runs: DataFrame, session: DataFrame, new_events: DataFrame, new_runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with one more session and its children; a session already there isn't added again."""
    fresh = session.join(sessions.select("session_uuid"), "session_uuid", "left_anti")
    add = lambda table, more: table.unionByName(more.join(fresh.select("session_uuid"), "session_uuid", "left_semi").select(*table.columns))
    return sessions.unionByName(fresh.select(*sessions.columns)), add(events, new_events), add(runs, new_runs)


def history(sessions: DataFrame, runs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Per session: end time, summed throw_count of its runs (0 without), and duration (0 unless it ends after it starts).

    Runs are summed by session before the join, so a session with many runs moves one row.
    """
    chosen = sessions if user_id is None else sessions.where(F.col("user_id") == user_id)
    totals = runs.groupBy("session_uuid").agg(F.sum("throw_count").alias("total"))
    duration = F.col("end_time") - F.col("start_time")
    return chosen.join(totals, "session_uuid", "left").select("user_id", "session_uuid", "start_time", F.col("end_time").alias("timestamp"), F.coalesce("total", F.lit(0)).cast("long").alias("total_throws"), F.when(duration > 0, duration).otherwise(F.lit(0.0)).alias("duration_seconds"))


def placed(rows: DataFrame) -> DataFrame:
    """history() with `place`, from 1, in the order of a user's sessions: by start, then key. The order of a user's rows
    is a column, so no table is sorted as a whole."""
    order = Window.partitionBy("user_id").orderBy("start_time", "session_uuid")
    return rows.withColumn("place", F.row_number().over(order).cast("int"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by `order`; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return least.select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest])


def all_users(users: DataFrame) -> DataFrame:
    return users.select("user_id", "name", "email")


def segment_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Throw and peak events of each key: three meanings of "throws" stay apart (throw events, peak events, run peaks)."""
    return events.groupBy(*keys).agg(F.count_if(F.col("event_type") == "throw").alias("total_throws"), F.count_if(F.col("event_type") == "peak").alias("total_peaks"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))


def with_rate(totals: DataFrame, count: str, duration: str) -> DataFrame:
    return totals.withColumn("rate", F.round(rate(F.col(count), F.col(duration)), 2))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()])


def healthy(events: DataFrame, runs: DataFrame) -> bool:
    return bool(events.head(1)) and bool(runs.head(1))
