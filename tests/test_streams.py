"""Streams against their batch forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tempora import catalogue
from tempora.functions import peaks
from tempora.streaming import live

SF = "/root/testdata/sf0.001"


def test_stream_runs(spark):
    a, b = catalogue.stream_runs(spark, SF), catalogue.runs_session_window(spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())) != []


def test_stream_peaks(spark):
    got = sorted((r.user_id, r.peak_time, r.peak_count) for r in catalogue.stream_peaks(spark, SF).collect())
    rows = catalogue.signal(spark, SF).orderBy("t", "value").collect()
    state, expected = {}, []
    for r in rows:
        ts, ys, last, n = state.get(r.user_id, ([], [], 0.0, 0))
        ts, ys = [*ts, r.t / 1e6][-20:], [*ys, r.value][-20:]
        if len(ts) >= 5:
            for i in peaks.find(-np.array(ys), catalogue.PROMINENCE):
                if ts[i] > last:
                    last, n = ts[i], n + 1
                    expected.append((r.user_id, last, n))
        state[r.user_id] = (ts, ys, last, n)
    assert got == sorted(expected) != []


def test_stream_peaks_of_equal_values(spark, tmp_path):
    """Lows of two or three equal values against the SQL, which counts none of them; find() counts them unless told not to."""
    import duckdb

    values = {1: [90, 10, 10, 95, 20, 90, 5, 90], 2: [90, 10, 90, 20, 20, 20, 99, 3, 3, 80], 3: [90, 9, 90, 9, 90, 70, 71]}
    rows = [(100 * u + i, u, "a", float(v), 60 * i) for u, vs in values.items() for i, v in enumerate(vs)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, s long")
    made.select("event_id", "user_id", "event_type", "value", F.timestamp_seconds(F.col("s") + 1_700_000_000).cast("timestamp_ntz").alias("ts")).write.parquet(f"file://{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = sorted(c.execute(f"SELECT user_id, peak_time, peak_count FROM ({catalogue.ORACLES['stream_peaks']})").fetchall())
    got = sorted((r.user_id, r.peak_time, r.peak_count) for r in catalogue.stream_peaks(spark, str(tmp_path)).collect())
    assert got == expected != []
    y = -np.array(values[2], float)
    assert peaks.find(y, 60.0).tolist() == [1, 4, 7] and peaks.find(y, 60.0, flat=False).tolist() == [1]


def test_audio_chunks(spark):
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(9)], "k string, i long, s double")
    got = {r.i: r.chunk for r in live.audio_chunks(rows, ["k"], "i", "s", 3.0).collect()}
    assert [got[i] for i in range(9)] == [0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_triggers(spark):
    rows = spark.createDataFrame([("reset",), ("hello",)], "text string")
    assert live.triggers(rows).select(F.col("reset")).collect()[0].reset and live.triggers(rows).count() == 1


def test_live_tracking(spark, tmp_path):
    """A stream of detections in two micro-batches against the tracker stepped frame by frame."""
    from tempora.config import DEFAULT
    from tempora.operators.tracking import Tracker

    rng = np.random.default_rng(1)
    rows, frames = [], {}
    for f in range(40):
        boxes = [] if f in (9, 10, 25) else [(100 + 4 * f + float(rng.normal()), 200.0, 400 - 5 * f)[b] for b in range(3)]
        frames[f] = np.array([[x, 50 + 60 * k, x + 20, 70 + 60 * k, 0.9] for k, x in enumerate(boxes)]).reshape(-1, 5)
        rows += [("v", f, f / 30, k, *map(float, b), 640, 480) for k, b in enumerate(frames[f])] or [("v", f, f / 30, 0, None, None, None, None, None, 640, 480)]
    schema = "video_id string, frame_idx int, timestamp double, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, width int, height int"
    for name, part in (("a", [r for r in rows if r[1] < 20]), ("b", [r for r in rows if r[1] >= 20])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*.parquet")
    got = catalogue._to_table(live.live_tracking(stream), "live", "append").collect()
    tracker, expected = Tracker(DEFAULT, max_distance=DEFAULT.live_max_distance, gravity=DEFAULT.live_gravity), []
    for f in range(40):
        expected += tracker.step(f, f / 30, frames[f], 640, 480)
    assert sorted(tuple(r)[1:] for r in got) == sorted(expected) and any(r.is_interpolated for r in got)


class Spotter:
    """Finds the bright square of a picture; counts what it is asked."""

    def __init__(self):
        self.asked = {"detect": 0, "detect_in": 0, "register": 0, "reset": 0, "register_background": 0}

    def detect(self, picture, motion=None):
        self.asked["detect"] += 1
        ys, xs = np.nonzero(picture[..., 0] > 200)
        return [(float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1), 0.9, 100)] if len(xs) else []

    def detect_in(self, picture, rois):
        self.asked["detect_in"] += 1
        found = self.detect(picture)
        self.asked["detect"] -= 1
        return found

    def __getattr__(self, name):
        if name.startswith("__") or name not in ("register", "reset", "register_background"):
            raise AttributeError(name)

        def note(*_):
            self.asked[name] += 1

        return note


def _ball(f):
    picture = np.zeros((120, 160, 3), np.uint8)
    y = int(20 + 60 * abs((f % 20) - 10) / 10)
    picture[y : y + 30, 60:90] = 255
    return picture


def test_live_pipeline(spark, tmp_path):
    """Blank frames, background and registration return early, rescans come each five frames, and peaks are counted."""
    from tempora.streaming.pipeline import LivePipeline, live_pipeline

    p = LivePipeline(Spotter())
    assert p.step(np.zeros((48, 64, 3), np.uint8), 0.0) == ("tracked", "full", 0)
    assert p.step(_ball(0), 0.03, background=True)[0] == "tracked" and p.step(_ball(1), 0.06)[0] == "background" and p.frames == 2
    scans = [p.step(_ball(f), f / 30)[1] for f in range(2, 62)]
    assert scans.count("regions") > 50 and p.peak_count >= 2 and len(p.tracker.live) >= 1
    assert p.detector.asked["detect"] >= 12 and p.detector.asked["register_background"] == 1
    assert p.step(_ball(0), 3.0, ball=True, reset=True)[0] == "registration" and p.detector.asked["register"] == p.detector.asked["reset"] == 1
    rows = [("v", f, f / 30, 160, 120, None if f == 3 else _ball(f).tobytes(), False, f == 5, False) for f in range(30)]
    schema = "video_id string, frame_idx int, timestamp double, width int, height int, frame binary, ball boolean, background boolean, reset boolean"
    for name, part in (("a", rows[:15]), ("b", rows[15:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*.parquet")
    got = {r.frame_idx: r for r in catalogue._to_table(live_pipeline(stream, lambda: LivePipeline(Spotter())), "pipeline", "append").collect()}
    one, expected = LivePipeline(Spotter()), {}
    for r in rows:
        expected[r[1]] = ("unread", "", 0) if r[5] is None else one.step(np.frombuffer(r[5], np.uint8).reshape(120, 160, 3), r[2], *r[6:])
    assert {f: (r.status, r.scan, r.detections) for f, r in got.items()} == expected
    assert got[6].status == "background" and got[29].peak_count == one.peak_count


def test_jdbc(spark):
    """A round trip through a database in memory."""
    from tempora.sources import files

    url = "jdbc:derby:memory:tempora;create=true"
    users = spark.createDataFrame([(i, f"user {i}") for i in range(50)], "user_key long, name string")
    files.write_jdbc(users, url, "users")
    files.write_jdbc(users.where("user_key < 3"), url, "users")
    got = files.read_jdbc(spark, url, "users", "user_key", 4)
    assert got.rdd.getNumPartitions() == 4 and sorted(r[0] for r in got.collect()) == sorted([*range(50), 0, 1, 2])
