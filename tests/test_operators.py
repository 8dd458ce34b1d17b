"""Operators on small cases worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import commands, evaluate, events, extrema, features, gapfill, history, overlay, runs, segments, signature, tracking
from tempora.functions import scalar
from tempora.plans.analysis import analyse, documents
from tempora.sources import files

POINTS = "video_id string, track_id int, frame_idx int, timestamp double, pos_x double, pos_y double, confidence double, is_interpolated boolean"


def points(spark, rows):
    return spark.createDataFrame([("v", k, f, float(t), float(x), float(y), float(c), False) for k, f, t, x, y, c in rows], POINTS)


@pytest.mark.parametrize("bucket", [None, 1.0, 3.0])
@pytest.mark.parametrize(
    ("times", "expected"),
    [([], []), ([0.0, 0.5], []), ([0, 0.5, 1.0, 2.0, 2.25, 2.5, 2.75, 10, 10.5], [(0, 1.0, 3), (2.0, 2.75, 4)]), ([0, 0, 0], [(0, 0, 3)]), ([0, 0.9, 1.9, 2.0], [(0, 2.0, 4)])],
)
def test_runs(spark, times, expected, bucket):
    rows = spark.createDataFrame([("a", float(t)) for t in times], "k string, timestamp double")
    got = runs.runs(rows, ["k"], bucket=bucket).orderBy("run_id").collect()
    assert [(r.start_time, r.end_time, r.throw_count) for r in got] == expected


@pytest.mark.parametrize(
    ("active", "expected"),
    [([], []), (range(20), [(0.0, 1.8)]), (range(20, 40), [(2.0, 3.9)]), ([*range(10), *range(15, 40)], [(0.0, 3.9)]), ([*range(10), *range(16, 40)], [(1.6, 3.9)]), (range(36), [(0.0, 3.5)]), (range(31), [(0.0, 2.9)]), ([0], [(0.0, 3.9)]), ([7], [])],
)
def test_segments(spark, active, expected):
    rows = spark.createDataFrame([("v", i, i / 10, 2 if i in set(active) else 1) for i in range(40)], "video_id string, frame_idx int, timestamp double, num_active_tracks int")
    got = segments.segments(rows).orderBy("segment_id").collect()
    assert [(r.start_time, r.end_time) for r in got] == expected
    assert all(r.confidence == 0.8 for r in got)


def test_features(spark):
    p = points(spark, [(0, 0, 0.0, 0.5, 0.0, 1), (0, 1, 1.0, 0.5, 1.0, 1), (1, 0, 0.0, 0.5, 0.0, 1), (1, 1, 1.0, 0.5, 3.0, 1)])
    videos = spark.createDataFrame([("v", 1.0, 10, 10, 3, 3.0)], "video_id string, fps double, width int, height int, frame_count int, duration double")
    got = features.frame_features(p, videos).orderBy("frame_idx").collect()
    assert [(r.num_active_tracks, r.mean_velocity_y, r.std_velocity_y) for r in got] == [(2, 0, 0), (2, 2.0, 1.0), (0, 0, 0)]


def fill(spark, rows, **k):
    got = gapfill.fill_gaps(points(spark, rows), ["video_id", "track_id"], **k)
    return got.where("is_filled").orderBy("frame_idx").collect()


def test_gap_lengths(spark):
    row = lambda f, y=0.5: (0, f, f / 10, 0.1, y, 0.5)
    assert [(r.frame_idx, r.pos_y) for r in fill(spark, [row(0), row(4)])] == [(1, 0.5), (2, 0.5), (3, 0.5)]
    assert [len(fill(spark, [row(0), row(n)])) for n in (1, 10, 11)] == [0, 9, 0]


def test_gap_parabola(spark):
    for up, expected in ((-2, None), (2, 0.4)):
        f = lambda t: (0.6 if up < 0 else 0.4) + up * (t - 0.25) ** 2  # noqa: B023,E731
        got = fill(spark, [(0, i, i / 10, i / 10, f(i / 10), 0.5) for i in (0, 1, 4, 5)])
        assert [r.frame_idx for r in got] == [2, 3]
        for r in got:
            assert r.pos_y == pytest.approx(f(r.timestamp) if expected is None else expected, abs=1e-4)
            assert r.pos_x == pytest.approx(r.timestamp) and not r.is_interpolated


def test_gap_fit_as_polyfit(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for k in range(40):
        frames = np.cumsum([0, *rng.integers(1, 3, 1), rng.integers(2, 9), *rng.integers(1, 3, 1)])[: 3 + k % 2]
        t, y = 100 + frames / 30, rng.uniform(0, 1, len(frames))
        rows += [(k, int(f), float(a), 0.1, float(b), 0.5) for f, a, b in zip(frames, t, y)]
        c = np.polyfit(t - t[1], y, 2)
        for f in range(frames[1] + 1, frames[2]):
            at = (f - frames[1]) / 30
            top = -c[1] / (2 * c[0])
            snap = abs(c[0]) > 1e-4 and abs(at - top) <= 0.7 / 30 and np.polyval(c, top) < min(y[1], y[2])
            expected[k, f] = np.polyval(c, top if snap else at)
    got = gapfill.fill_gaps(points(spark, rows), ["video_id", "track_id"]).where("is_filled").collect()
    for r in got:
        if (r.track_id, r.frame_idx) in expected:
            assert r.pos_y == pytest.approx(expected[r.track_id, r.frame_idx], abs=2e-4)


def edge_case(spark, step):
    p = points(spark, [(0, i, round(i * step, 4), 0.5, y, 1) for i, y in enumerate((0.10, 0.30, 0.50, 0.30, 0.10))])
    s = spark.createDataFrame([("v", 0, 0.0, 9.0, 0.8)], "video_id string, segment_id int, start_time double, end_time double, confidence double")
    return [(r.event_type, r.timestamp, r.confidence) for r in events.events(p, s).orderBy("event_id").collect()]


def test_edge_peaks(spark):
    assert edge_case(spark, 0.1) == [("peak", 0.0, 0.7), ("throw", 0.2, 0.9), ("peak", 0.4, 0.7)]
    assert edge_case(spark, 0.05) == [("peak", 0.0, 0.7), ("throw", 0.1, 0.9)]


def test_extrema_two_ways(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(int(k), i, float(v)) for k in range(5) for i, v in enumerate(rng.integers(0, 9, 60))], "k int, i int, y double")
    for sign in (1, -1):
        a = extrema.extrema(rows, ["k"], "i", "y", 3.0, sign=sign)
        b = extrema.extrema_sql(rows, ["k"], "i", "y", 3.0, sign).select("k", "i", "y")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


def test_history(spark):
    s = spark.createDataFrame([("s1", "u", 0.0, 5.0), ("s2", "u", 2.0, 2.0), ("s3", "w", 0.0, 1.0)], "session_uuid string, user_id string, start_time double, end_time double")
    r = spark.createDataFrame([("s1", 3), ("s1", 5)], "session_uuid string, throw_count int")
    got = history.history(s, r, "u").orderBy("start_time").collect()
    assert [(x.timestamp, x.total_throws, x.duration_seconds) for x in got] == [(5.0, 8, 5.0), (2.0, 0, 0.0)]


def test_upsert_and_insert(spark):
    users = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "user_id string, name string, email string")
    change = spark.createDataFrame([("b", "z", "3", 1), ("b", "w", "4", 2), ("c", "v", "5", 1)], "user_id string, name string, email string, n int")
    assert sorted(map(tuple, history.upsert(users, change, "user_id", "n").collect())) == [("a", "x", "1"), ("b", "w", "4"), ("c", "v", "5")]
    s = spark.createDataFrame([("s1", "a")], "session_uuid string, user_id string")
    e = spark.createDataFrame([("s1", 1.0)], "session_uuid string, timestamp double")
    one = spark.createDataFrame([("s2", "b")], s.schema)
    for repeat in (1, 2):
        s2, e2, _ = history.insert_session(s, e, e, one, spark.createDataFrame([("s2", 2.0)], e.schema), e.limit(0))
        assert s2.count() == 2 and e2.count() == 2, repeat
        s, e = s2, e2


def test_overlay(spark):
    frames = spark.createDataFrame([("v", i, float(i)) for i in range(12)], "video_id string, frame_idx int, timestamp double")
    marks = spark.createDataFrame([("v", 1.0, "throw"), ("v", 2.0, "throw"), ("v", 2.5, "peak"), ("v", 7.0, "throw")], "video_id string, timestamp double, event_type string")
    found = spark.createDataFrame([("v", 1, 1.0, 3.0, 3), ("v", 2, 6.0, 8.0, 4)], "video_id string, run_order int, start_time double, end_time double, throw_count long")
    spans = spark.createDataFrame([("v", 0.0, 4.0)], "video_id string, start_time double, end_time double")
    got = {r.frame_idx: r for r in overlay.overlay(frames, marks, found, spans).collect()}
    assert [got[i].session_throws for i in (0, 1, 2, 7)] == [0, 1, 2, 3]
    assert (got[3].current_run, got[3].mean_throws, got[3].current_run_throws) == (1, 0.0, 2)
    assert (got[4].current_run, got[4].mean_throws, got[4].median_throws) == (-1, 3.0, 3.0)
    assert (got[9].mean_throws, got[9].median_throws, got[9].in_segment) == (3.5, 3.5, False)
    assert [got[i].flashing for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and got[4].in_segment


def test_commands(spark):
    rows = spark.createDataFrame([("Register Bowl",), ("back to the ground",), ("reset the ball",), ("hello",), (None,)], "text string")
    got = [(r.ball, r.background, r.reset) for r in commands.commands(rows).collect()]
    assert got == [(True, False, False), (False, True, False), (True, False, True), (False, False, False), (False, False, False)]


def test_folders_and_rates(spark):
    got = spark.createDataFrame([("a_b.mov_n_320",), ("x_y",)], "f string").select(evaluate.folder_parts(F.col("f")).alias("p")).collect()
    assert tuple(got[0].p) == ("a_b.mov", "N", 320) and got[1].p is None
    r = spark.createDataFrame([(6.0, 4.0), (6.0, 0.0)], "n double, d double").select(scalar.rate_label(F.col("n"), F.col("d")).alias("r")).collect()
    assert [x.r for x in r] == ["1.50 t/s", "0 t/s"]


def test_rollup(spark):
    rows = spark.createDataFrame([("a", 30), ("a", 35), ("b", 3)], "k string, throw_count long")
    got = {r.k: r for r in evaluate.rollup(rows, ["k"]).collect()}
    assert (got["a"].total_throws, got["a"].max_streak, got["a"].combined_error, got["a"].runs) == (65, 35, 0, [30, 35])
    assert evaluate.best(evaluate.rollup(rows, ["k"]), ["k"], 1).first().k == "a"


def test_mosaic(spark):
    grid = scalar.mosaic_grid(F.lit(5), F.lit(640))
    box = {"x1": F.lit(215), "x2": F.lit(225), "y1": F.lit(5), "y2": F.lit(15)}
    last = {"x1": F.lit(600), "x2": F.lit(610), "y1": F.lit(600), "y2": F.lit(610)}
    r = spark.range(1).select(grid["grid"].alias("g"), grid["cell"].alias("c"), scalar.mosaic_box(box, F.lit(5), grid["cell"], grid["grid"]).alias("a"), scalar.mosaic_box(last, F.lit(5), grid["cell"], grid["grid"]).alias("b")).first()
    assert (r.g, r.c, r.a, r.b) == (3, 213, 1, None)


def test_signature(spark):
    s = spark.createDataFrame([("a", [0.0, 2.0]), ("a", [2.0, 4.0])], "label string, color array<float>")
    merged = signature.as_vectors(signature.merge(s, ["label"], "color"), ["label"])
    assert merged.select(signature.min_max(F.col("merged")).alias("m")).first().m == [0.0, 255.0] and merged.first().merged == [1.0, 3.0]
    known = spark.createDataFrame([("a", 100)], "label string, class_id int")
    got = {r.label: r.class_id for r in signature.register(spark.createDataFrame([("a",), ("c",), ("b",)], "label string"), known).collect()}
    assert got == {"a": 100, "b": 101, "c": 102}


def test_lbp():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    codes = signature.lbp(g)
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    for i in range(12):
        for j in range(9):
            inside = 0 < i < 11 and 0 < j < 8
            assert codes[i, j] == (sum(1 << k for k, (a, b) in enumerate(around) if g[i + a, j + b] >= g[i, j]) if inside else 0)
    assert signature.texture_histogram(g).sum() == pytest.approx(1, abs=1e-5)


def test_ema_and_tail(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, i int, v double")
    e = 0.0
    for i in range(1, 5):
        e = 0.7 * e + 0.3 * i
    assert overlay.ema(rows, ["k"], "i", "v", 0.3).first().ema == pytest.approx(e)
    assert [len(r.tail) for r in overlay.tail(rows, ["k"], "i", ["v"], 3).orderBy("i").collect()] == [1, 2, 3, 3, 3]


# tracking


def test_life_cycle():
    t = tracking.Tracker()
    box = np.array([[100.0, 100, 120, 120, 0.9]])
    none = np.zeros((0, 5))
    states = []
    for i in range(3):
        t.step(i, i / 30, box, 640, 480)
        states.append(t.live[0].state)
    assert states == ["TENTATIVE", "TENTATIVE", "CONFIRMED"]
    confidences = [t.step(3 + k, (3 + k) / 30, none, 640, 480)[0][5] for k in range(10)]
    assert confidences == pytest.approx([0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.01]) and not t.live


def test_distance_is_strict():
    for distance, same in ((119.999, True), (120.0, False)):
        t = tracking.Tracker(gravity=0.0)
        t.step(0, 0.0, np.array([[0.0, 0, 20, 20, 1]]), 640, 480)
        t.step(1, 1 / 30, np.array([[distance, 0, 20 + distance, 20, 1]]), 640, 480)
        assert (t.next_id == 1) is same


def cascade(spark, frames=240, fps=30.0):
    rows = []
    for f in range(frames):
        for b in range(3):
            phase = (f / 40 + b / 3) % 1
            x, y = 150 + 300 * (phase if (f // 40 + b) % 2 else 1 - phase), 400 - 4 * 340 * phase * (1 - phase)
            rows.append(("v", f, f / fps, b, x, y, x + 24, y + 24, 0.9, 32))
    detections = spark.createDataFrame(rows, "video_id string, frame_idx int, timestamp double, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    videos = spark.createDataFrame([("v", fps, 640, 480, frames, frames / fps)], "video_id string, fps double, width int, height int, frame_count int, duration double")
    return detections, videos


def test_track_as_one_by_one(spark):
    """The streamed operator against the tracker stepped over every frame, empty ones included."""
    detections, videos = cascade(spark, 60)
    holes = detections.where("frame_idx < 20 or frame_idx > 34")
    got = sorted(map(tuple, tracking.track(holes, videos, stride=2).select("track_id", "frame_idx", "timestamp", "pos_x", "pos_y", "confidence", "is_interpolated").collect()))
    t, expected = tracking.Tracker(), []
    rows = holes.collect()
    for f in range(0, 60, 2):
        boxes = np.array([[r.x1, r.y1, r.x2, r.y2, r.confidence] for r in rows if r.frame_idx == f]).reshape(-1, 5)
        expected += t.step(f, f / 30, boxes, 640, 480)
    assert got == sorted(expected) and any(r[-1] for r in got)


def test_whole_analysis(spark, tmp_path):
    detections, videos = cascade(spark)
    a = analyse(detections, videos)
    p = a.points.collect()
    assert len({(r.track_id, r.frame_idx) for r in p}) == len(p)
    assert a.features.count() == 240 and a.segments.count() >= 1
    kinds = {r.event_type: r["count"] for r in a.events.groupBy("event_type").count().collect()}
    assert kinds["peak"] >= 10 and a.runs.count() >= 1
    path = f"file://{tmp_path}/out"
    files.write_analysis(documents(a), path)
    back = spark.read.json(path).first()
    assert back.video_id == "v" and len(back.segments) == a.segments.count() and sum(s.total_peaks for s in back.segments) == kinds["peak"]


def test_match(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0)], "f int, id long, x double, y double")
    b = spark.createDataFrame([(0, 7, 0.1, 0.0), (0, 8, 5.0, 0.0), (1, 9, 0.0, 0.0)], "f int, id long, x double, y double")
    got = sorted(map(tuple, tracking.match(a, b, ["f"], 1.0).collect()))
    assert got == [(0, 1, 7, pytest.approx(0.1))]


def test_frames(spark):
    f = spark.range(40).withColumnRenamed("id", "frame_idx")
    assert [r.frame_idx for r in files.every(f.where("frame_idx < 5")).collect()] == [0, 2, 4]
    assert [r.frame_idx for r in files.clip(f, 0.5, 1.0, 30).collect()] == list(range(15, 30))


def test_result_folders(spark, tmp_path):
    for folder, text in (("a_b.mov_n_320", '{"video_id": "v"}'), ("x_y", '{"video_id": "w"}'), ("c_m_640", "{broken")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "analysis.json").write_text(text)
    got = files.scan_results(spark, f"file://{tmp_path}").select("video_id", "folder.video", "folder.model", "folder.resolution").collect()
    assert [tuple(r) for r in got] == [("v", "a_b.mov", "N", 320)]


def test_cached(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []
    make = lambda: made.append(1) or spark.range(3)
    for force in (False, False, True):
        assert files.cached(spark, path, make, force).count() == 3
    assert len(made) == 2


def test_consumed_commands(spark):
    frames = spark.createDataFrame([("a", float(t), t) for t in (1, 3, 5)], "k string, timestamp double, n int")
    said = spark.createDataFrame([("a", 1.5, "register ball"), ("a", 2.0, "ball"), ("a", 4.0, "reset"), ("a", 4.5, "hello"), ("a", 6.0, "reset")], "k string, timestamp double, text string")
    got = {r.n: (r.ball, r.background, r.reset) for r in commands.consumed(frames, said, ["k"]).collect()}
    assert got == {1: (False, False, False), 3: (True, False, False), 5: (False, False, True)}


def test_coast(spark):
    rows = spark.createDataFrame([("a", 0, None, None), ("a", 1, 10.0, 10.0), ("a", 2, 14.0, 12.0), ("a", 3, None, None), ("a", 4, None, None), ("a", 5, 30.0, 30.0)], "k string, i int, x double, y double")
    got = [(r.x, r.y) for r in tracking.coast(rows, ["k"], "i", "x", "y").orderBy("i").collect()]
    assert got == [(None, None), (10, 10), (14, 12), (16, 13), (18, 15), (30, 30)]


def test_scores_and_overlap(spark):
    a = spark.createDataFrame([("v", 1.0), ("v", 5.0), ("v", 9.0)], "video_id string, timestamp double")
    b = spark.createDataFrame([("v", 1.1), ("v", 5.4), ("v", 9.05), ("v", 9.2)], "video_id string, timestamp double")
    r = evaluate.event_scores(a, b, 0.25).first()
    assert (r.n_true, r.n_found, r.hits, r.f1) == (3, 4, 2, pytest.approx(4 / 7))
    s = spark.createDataFrame([("v", 0, 0.0, 4.0), ("v", 1, 10.0, 12.0)], "video_id string, segment_id int, start_time double, end_time double")
    t = spark.createDataFrame([("v", 0, 2.0, 6.0)], s.schema)
    assert [(x.a_id, x.b_id, x.iou) for x in evaluate.interval_overlap(s, t).collect()] == [(0, 0, pytest.approx(1 / 3))]


def test_gates(spark):
    rows = spark.createDataFrame([(500.0, 24.0, 24.0, 80.0, True), (500.0, 24.0, 24.0, 0.0, True), (500.0, 24.0, 24.0, 80.0, False), (300.0, 24.0, 24.0, 60.0, True), (500.0, 40.0, 24.0, 80.0, True), (500.0, 24.0, 24.0, 110.0, True)], "a double, w double, h double, p double, e boolean")
    gate = scalar.contour_gate(F.col("a"), F.col("w"), F.col("h"), F.col("p"), F.col("e"))
    assert [r.g for r in rows.select(gate.alias("g")).collect()] == [True, False, False, False, False, False]
    box = scalar.clipped_box(F.lit(-3.7), F.lit(2.9), F.lit(700.0), F.lit(2.0), F.lit(640), F.lit(480))
    r = spark.range(1).select(*[c.alias(k) for k, c in box.items()], scalar.in_reticle(F.lit(49), F.lit(0), F.lit(0), F.lit(0)).alias("in"), scalar.in_reticle(F.lit(50), F.lit(0), F.lit(0), F.lit(0)).alias("out"), scalar.as_timestamp(F.lit(90.0)).cast("string").alias("t")).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.empty, r["in"], r.out, r.t) == (0, 2, 640, 2, True, True, False, "1970-01-01 00:01:30")


def test_classes(spark):
    rows = spark.createDataFrame([(32,), (7,)], "c int")
    of = lambda **k: [r.c for r in rows.where(scalar.class_gate(F.col("c"), **k)).collect()]
    assert of(allowed=None) == [32] and of(allowed=[7]) == [7] and of(allowed=None, targets=None) == [32, 7]


def test_scan_mode():
    assert tracking.full_scan(30, {0: (0.5, 0.5, 0.1, 0.1)}, True) and tracking.full_scan(31, {}, True) and tracking.full_scan(31, {0: (0.5, 0.5, 0.1, 0.1)}, False)
    assert not tracking.full_scan(31, {0: (0.5, 0.5, 0.1, 0.1)}, True)
    assert tracking.regions({0: (0.5, 0.4, 0.1, 0.2)}) == [(0.5, 0.4, 0.4, 0.8)]
    t = tracking.Tracker(gravity=0.0)
    for i in range(3):
        t.step(i, i / 30, np.array([[100.0 + 10 * i, 100, 120 + 10 * i, 120, 1]]), 640, 480)
    x, y, w, h = t.predictions(3 / 30)[0]
    assert 130 / 640 < x <= 141 / 640 and y == pytest.approx(110 / 480, abs=0.01)
    assert (w, h) == (pytest.approx(20 / 640), pytest.approx(20 / 480))
    assert t.snapshot()[0][:4] == (0, "CONFIRMED", 3, 0)
    t.retune(gravity=0.5, interpolate=False)
    assert t.filters.gravity == 0.5 and not t.step(3, 0.1, np.zeros((0, 5)), 640, 480)


def test_reports_and_tables(spark, tmp_path):
    files.write_report(spark.createDataFrame([("a", 1)], "k string, n int"), f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").first().k == "a"
    for _ in (1, 2):
        files.create_tables(spark)
    assert spark.table("runs").count() == 0 and "session_uuid" in spark.table("events").columns
    r = evaluate.throughput(spark.createDataFrame([(300, 12.3), (300, None)], "frame_count int, total_time double")).collect()
    assert [x.fps for x in r] == [24.4, None]
    assert not history.healthy(spark.table("events"), spark.table("runs"))
