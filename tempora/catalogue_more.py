"""More registered queries: frames and sources, gates, assignment and tracking, commands, pixels, sessions.

As in `catalogue`, the driver's tables stand in for videos: a user's events are the boxes of a video, the 64 components
of an embedding are an 8 x 8 picture, conversations are transcripts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.catalogue import _ROLLUP, _RUNS, _gap_sql, _LINE, _even, HOUR, HOURLY, ORIGIN_SQL, RUN_GAP, SIGNAL, _rollup, _runs, _sessions, _stream, _to_table, hourly, query, signal, table
from tempora.functions import scalar, vision
from tempora.operators import commands, evaluate, events, gapfill, history, signature, tracking
from tempora.sources import files
from tempora.sources.shared import new_path
from tempora.streaming import live

# frames and sources


def _frames(spark, sf_dir) -> DataFrame:
    """A user's events as frames, numbered in order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return signal(spark, sf_dir).withColumn("frame_idx", place.cast("int")).withColumn("video_id", F.col("user_id").cast("string"))


FRAMES = f"""{SIGNAL},
frames AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS frame_idx, CAST(user_id AS VARCHAR) AS video_id FROM signal)"""


@query(f"WITH {FRAMES} SELECT video_id, event_id FROM frames WHERE frame_idx = 7")
def frame_lookup(spark, sf_dir):
    return files.frame_at(_frames(spark, sf_dir), 7).select("video_id", "event_id")


@query(f"WITH {FRAMES} SELECT video_id, 30.0::DOUBLE AS fps, 640 AS width, 480 AS height, CAST(count(*) AS INTEGER) AS frame_count, count(*) / 30.0::DOUBLE AS duration FROM frames GROUP BY video_id")
def video_metadata(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("video_id", F.lit(30.0).alias("rate"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return files.metadata(rows, F.col("rate"))


@query(f"WITH {FRAMES} SELECT video_id, frame_idx, event_id FROM frames WHERE frame_idx >= 3 AND frame_idx < 20")
def row_cap(spark, sf_dir):
    return files.first_frames(_frames(spark, sf_dir), 20, 3).select("video_id", "frame_idx", "event_id")


@query(f"WITH {FRAMES} SELECT 'test_user' AS user_id, frame_idx, event_id FROM frames WHERE frame_idx < 50")
def test_mode_rows(spark, sf_dir):
    return files.test_mode(_frames(spark, sf_dir), 50).select("user_id", "frame_idx", "event_id")


def _documents(spark, sf_dir) -> DataFrame:
    """A document a user: its frames' metadata and its runs, in the shape of the JSON document."""
    found = _runs(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((F.col("start_time") / 1e6).alias("start_time"), (F.col("end_time") / 1e6).alias("end_time"), F.col("n_events").cast("int").alias("throw_count")))).alias("runs"))
    meta = F.struct(F.lit(30.0).alias("fps"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.size("runs").alias("frame_count"), F.lit(1.0).alias("duration"))
    none = spark.createDataFrame([], files.schemas.ANALYSIS).schema
    kinds = {f.name: f.dataType for f in none}
    return found.select(F.col("user_id").cast("string").alias("video_id"), meta.alias("video_metadata"), F.array().cast(kinds["segments"]).alias("segments"), F.array().cast(kinds["tracks"]).alias("tracks"), "runs")


_FLAT = _RUNS + " SELECT CAST(user_id AS VARCHAR) AS video_id, start_time / 1e6 AS start_time, end_time / 1e6 AS end_time, CAST(n_events AS INTEGER) AS throw_count FROM runs"


@query(_FLAT)
def json_documents(spark, sf_dir):
    path = new_path(spark, "documents")
    files.write_analysis(_documents(spark, sf_dir), path)
    return files.read_analysis(spark, path, lines=True).select("video_id", F.explode("runs").alias("r")).select("video_id", "r.start_time", "r.end_time", "r.throw_count")


@query("""WITH c AS (SELECT 'a_f.mov' AS video, 'N' AS model, 320 AS resolution UNION ALL SELECT 'a_f.mov', 'X', 1280)
SELECT video, model, resolution, count(DISTINCT user_id) AS documents FROM c, (""" + _RUNS + " SELECT user_id FROM runs) GROUP BY ALL")
def result_folders(spark, sf_dir):
    """Folders video_model_resolution, one of another name and one with a broken document."""
    path = new_path(spark, "results")
    docs = _documents(spark, sf_dir)
    for name in ("a_f.mov_n_320", "a_f.mov_x_1280", "other"):
        files.write_document(docs, f"{path}/{name}/analysis.json")
    files.write_document(spark.createDataFrame([("{broken",)], "value string"), f"{path}/b_n_640/analysis.json")
    return files.scan_results(spark, path, lines=True).groupBy("folder.video", "folder.model", "folder.resolution").agg(F.countDistinct("video_id").alias("documents"))


@query(_ROLLUP + " SELECT l_suppkey, total_throws, max_streak, run_count, combined_error FROM e")
def csv_report(spark, sf_dir):
    path = new_path(spark, "report")
    columns = ["l_suppkey", "total_throws", "max_streak", "run_count", "combined_error"]
    report = _rollup(spark, sf_dir).select(*columns)
    files.write_report(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query("SELECT 2 AS reads, count(*) AS n, 1 AS made FROM events")
def result_cache(spark, sf_dir):
    """The second read finds the first one's table."""
    path, made = new_path(spark, "cache"), []

    def make():
        made.append(1)
        return table(spark, sf_dir, "events").select("event_id")

    for _ in range(2):
        rows = files.cached(spark, path, make)
    return rows.agg(F.count("*").alias("n")).select(F.lit(2).alias("reads"), "n", F.lit(len(made)).alias("made"))


@query("SELECT * FROM (VALUES ('events', 7), ('runs', 7), ('sessions', 4), ('users', 3)) AS t(table_name, n_columns)")
def created_tables(spark, sf_dir):
    return files.table_shapes(spark, "tempora", new_path(spark, "database"))


# gates and columns


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(0, trunc(l_quantity * 20 - 200)) AS INTEGER) AS x1, CAST(greatest(0, trunc(l_tax * 9000 - 100)) AS INTEGER) AS y1,
CAST(least(640, trunc(l_quantity * 20 - 100)) AS INTEGER) AS x2, CAST(least(480, trunc(l_tax * 9000)) AS INTEGER) AS y2,
least(640, trunc(l_quantity * 20 - 100)) <= greatest(0, trunc(l_quantity * 20 - 200)) OR least(480, trunc(l_tax * 9000)) <= greatest(0, trunc(l_tax * 9000 - 100)) AS empty FROM lineitem""")
def box_clip(spark, sf_dir):
    x, y = F.col("l_quantity") * 20 - 200, F.col("l_tax") * 9000 - 100
    x2, y2 = F.col("l_quantity") * 20 - 100, F.col("l_tax") * 9000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in scalar.clipped_box(x, y, x2, y2, F.lit(640), F.lit(480)).items()])


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, l_quantity AS w, l_tax * 600 + 10 AS h, l_quantity * (l_tax * 600 + 10) * 0.75 AS area, 2 * (l_quantity + l_tax * 600 + 10) * (0.8 + l_discount) AS per FROM lineitem)
WHERE area >= 400 AND CASE WHEN h > 0 THEN w / h ELSE 0 END > 0.7 AND CASE WHEN h > 0 THEN w / h ELSE 0 END < 1.4 AND 4 * 3.141592653589793 * area / (per * per) >= 0.65 AND l_linenumber <= 4""")
def contour_gates(spark, sf_dir):
    w, h = F.col("l_quantity"), F.col("l_tax") * 600 + 10
    per = 2 * (w + F.col("l_tax") * 600 + 10) * (F.lit(0.8) + F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where(scalar.contour_gate(w * h * 0.75, w, h, per, F.col("l_linenumber") <= 4)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_quantity * 12 - 320) < 50 AND abs(l_tax * 6000 - 240) < 50")
def reticle(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(scalar.in_reticle(F.col("l_quantity") * 12, F.col("l_tax") * 6000, F.lit(320), F.lit(240))).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1')")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(scalar.holds(F.col("p_name"), "1")).select("p_partkey", "p_name")


@query(f"WITH {SIGNAL} SELECT event_id, epoch_us(make_timestamp(CAST(t // 1000000 * 1000000 AS BIGINT))) AS at FROM signal")
def epoch_times(spark, sf_dir):
    return signal(spark, sf_dir).select("event_id", F.unix_micros(scalar.as_timestamp(F.expr("t div 1000000"))).alias("at"))


def _spans(spark, sf_dir) -> DataFrame:
    """Runs of five or more events as segments of their user's video."""
    found = _runs(spark, sf_dir).where("n_events >= 5")
    return found.select(F.col("user_id").alias("video_id"), F.col("run_id").alias("segment_id"), "start_time", "end_time")


@query(_RUNS + ", s AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_time) AS INTEGER) AS segment_id FROM runs) WHERE n_events >= 5) SELECT f.user_id AS video_id, s.segment_id, f.event_id FROM signal f JOIN s ON s.user_id = f.user_id AND f.t BETWEEN s.start_time AND s.end_time")
def segment_points(spark, sf_dir):
    points = signal(spark, sf_dir).select(F.col("user_id").alias("video_id"), "event_id", F.col("t").alias("timestamp"))
    return events.segment_points(points, _spans(spark, sf_dir)).select("video_id", "segment_id", "event_id")


@query(_RUNS + """, s AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_time) AS INTEGER) AS segment_id FROM runs) WHERE n_events >= 5)
SELECT f.user_id AS video_id, s.segment_id, f.event_id, CAST(row_number() OVER (PARTITION BY f.user_id, s.segment_id ORDER BY f.t, f.event_id % 3, CASE f.event_type WHEN 'click' THEN 1 ELSE 0 END, f.event_id) - 1 AS INTEGER) AS place FROM signal f JOIN s ON s.user_id = f.user_id AND f.t BETWEEN s.start_time AND s.end_time""")
def event_order(spark, sf_dir):
    """Events of a segment by time, then track, then kind."""
    points = signal(spark, sf_dir).select(F.col("user_id").alias("video_id"), "event_id", F.col("t").alias("timestamp"), (F.col("event_id") % 3).alias("track_id"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("step"))
    inside = events.segment_points(points, _spans(spark, sf_dir))
    return events.numbered(inside, ["timestamp", "track_id", "step", "event_id"], "place").select("video_id", "segment_id", "event_id", F.col("place").cast("int").alias("place"))


@query(_even(f"{_gap_sql(_LINE)} UNION ALL SELECT track_id, frame_idx, round_even_(pos_y * 1e4) / 1e4 AS pos_y, round_even_(pos_x * 1e4) / 1e4 AS pos_x FROM hourly").replace("SELECT track_id, CAST(frame_idx + j", "SELECT true AS is_filled, track_id, CAST(frame_idx + j").replace("UNION ALL SELECT track_id", "UNION ALL SELECT false AS is_filled, track_id"))
def gapfill_union(spark, sf_dir):
    """Given points and filled ones together, with the flag that tells them apart."""
    found = gapfill.fill_gaps(hourly(spark, sf_dir), ["track_id"], quadratic=False)
    return found.select("is_filled", "track_id", "frame_idx", scalar.round4(F.col("pos_y")).alias("pos_y"), scalar.round4(F.col("pos_x")).alias("pos_x"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0.02 THEN l_quantity / (l_tax * 100) END, 1) AS fps FROM lineitem")
def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("frame_count"), F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100).alias("total_time"))
    return evaluate.throughput(rows).select("l_orderkey", "l_linenumber", "fps")


# assignment and tracking

_SMALL = """e AS (SELECT CAST(floor(vec_id / 7) AS BIGINT) AS frame, vec_id % 2 = 0 AS is_left, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
f AS (SELECT frame, list({'id': id, 'x': x, 'y': y} ORDER BY id) FILTER (WHERE is_left) AS l, list({'id': id, 'x': x, 'y': y} ORDER BY id) FILTER (WHERE NOT is_left) AS r FROM e GROUP BY frame HAVING count(*) FILTER (WHERE is_left) > 0 AND count(*) FILTER (WHERE NOT is_left) > 0),
p AS (SELECT frame, l, r, 1 AS k, CAST([] AS BIGINT[]) AS a, 0.0::DOUBLE AS total, 0 AS skipped FROM f
  UNION ALL SELECT frame, l, r, k + 1, list_append(a, c), total + CASE WHEN c = 0 THEN 0 ELSE sqrt((l[k].x - r[c].x) * (l[k].x - r[c].x) + (l[k].y - r[c].y) * (l[k].y - r[c].y)) END, skipped + CASE WHEN c = 0 THEN 1 ELSE 0 END
  FROM (SELECT *, unnest(range(0, len(r) + 1)) AS c FROM p WHERE k <= len(l)) WHERE c = 0 AND skipped < len(l) - len(r) OR c > 0 AND NOT list_contains(a, c)),
b AS (SELECT frame, any_value(l) AS l, any_value(r) AS r, min_by(a, total) AS a FROM p WHERE k > len(l) GROUP BY frame),
m AS (SELECT frame, l[i] AS u, r[a[i]] AS v FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b) WHERE a[i] > 0),
found AS (SELECT frame, u.id AS left_id, v.id AS right_id, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) AS distance FROM m)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 7).alias("frame"), F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


@query(f"WITH RECURSIVE {_SMALL} SELECT frame, left_id, right_id, round(distance, 6) AS distance FROM found WHERE distance < 0.3")
def optimal_pairs(spark, sf_dir):
    """Frames of seven points on two sides, whose assignments SQL can try all."""
    return tracking.match(*_sides(spark, sf_dir), ["frame"], 0.3).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {_SMALL}, near AS (SELECT * FROM found WHERE distance < 0.3)
SELECT frame, id, CASE WHEN is_left THEN 'left' ELSE 'right' END AS side FROM e WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.frame = e.frame AND e.id IN (near.left_id, near.right_id))""")
def unmatched_sides(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    found = tracking.match(left, right, ["frame"], 0.3)
    one = lambda side, name: tracking.unmatched(side, found, ["frame"], f"{name}_id").select("frame", "id", F.lit(name).alias("side"))
    return one(left, "left").unionByName(one(right, "right"))


_TRACKS = "STRUCT(id INTEGER, stamp DOUBLE, hits INTEGER, inactive INTEGER, x DOUBLE, y DOUBLE, vx DOUBLE, vy DOUBLE, p DOUBLE, c DOUBLE, v DOUBLE, w DOUBLE, h DOUBLE)[]"
_POINT = "STRUCT(track_id INTEGER, x DOUBLE, y DOUBLE, confidence DOUBLE, synthetic BOOLEAN)[]"
_KEEP = "'id': t.id, 'stamp': {stamp}, 'hits': {hits}, 'inactive': {inactive}, 'x': {x}, 'y': {y}, 'vx': {vx}, 'vy': {vy}, 'p': {p}, 'c': {c}, 'v': {v}, 'w': {w}, 'h': {h}"


def _kept(**new: str) -> str:
    return "{" + _KEEP.format(**{k: new.get(k, f"t.{k}") for k in ("stamp", "hits", "inactive", "x", "y", "vx", "vy", "p", "c", "v", "w", "h")}) + "}"


def _r4(x: str) -> str:
    return f"(round_even(({x}) * 1e4, 0) / 1e4)"


def _track_sql(idle: int, last: str) -> str:
    """The tracker frame by frame: prediction, the nearest track within reach, update, ageing and coasting, birth.

    With one box a frame the best assignment is the nearest track.
    """
    dt = "(CASE WHEN now - t.stamp > 0 THEN now - t.stamp ELSE 1.0::DOUBLE / 30 END)"
    predicted = _kept(x=f"t.x + t.vx * {dt}", y=f"t.y + t.vy * {dt}", vy=f"t.vy + 0.001::DOUBLE * {dt}", p=f"t.p + 2 * {dt} * t.c + {dt} * {dt} * t.v + 0.01::DOUBLE", c=f"t.c + {dt} * t.v", v="t.v + 0.01::DOUBLE * 10")
    gain, drift = "(t.p / (t.p + 0.001::DOUBLE))", "(t.c / (t.p + 0.001::DOUBLE))"
    size = lambda k, new: f"(1 - 0.3::DOUBLE) * t.{k} + 0.3::DOUBLE * ({new})"
    updated = _kept(x=f"t.x + {gain} * (cx - t.x)", y=f"t.y + {gain} * (cy - t.y)", vx=f"t.vx + {drift} * (cx - t.x)", vy=f"t.vy + {drift} * (cy - t.y)", p=f"(1 - {gain}) * t.p", c=f"(1 - {gain}) * t.c", v=f"t.v - {drift} * t.c", hits="t.hits + 1", inactive="0", stamp=_r4("now"), w=size("w", "bw"), h=size("h", "bh"))
    aged = _kept(inactive="t.inactive + 1", stamp=f"CASE WHEN t.hits >= 3 THEN {_r4('now')} ELSE t.stamp END")
    born = "{'id': next_id, 'stamp': " + _r4("now") + ", 'hits': 1, 'inactive': 0, 'x': cx, 'y': cy, 'vx': 0.0::DOUBLE, 'vy': 0.0::DOUBLE, 'p': 1.0::DOUBLE, 'c': 0.0::DOUBLE, 'v': 1.0::DOUBLE, 'w': bw, 'h': bh}"
    far = "sqrt(((t.x - cx) * 640) * ((t.x - cx) * 640) + ((t.y - cy) * 512) * ((t.y - cy) * 512))"
    seen = "{'track_id': hit, 'x': " + _r4("cx") + ", 'y': " + _r4("cy") + ", 'confidence': 0.5::DOUBLE, 'synthetic': false}"
    coasting = "{'track_id': t.id, 'x': " + _r4("greatest(0, least(1, t.x))") + ", 'y': " + _r4("greatest(0, least(1, t.y))") + ", 'confidence': " + _r4("greatest(0.01::DOUBLE, 0.1::DOUBLE * (1 - (t.inactive + 1) / 10.0::DOUBLE))") + ", 'synthetic': true}"
    return f"""WITH RECURSIVE {FRAMES},
d AS (SELECT video_id, frame_idx, (value % 100 * 6 + (value % 100 * 6 + 20)) / 2 / 640 AS cx, (value + (value + 20)) / 2 / 512 AS cy, ((value % 100 * 6 + 20) - value % 100 * 6) / 640 AS bw, ((value + 20) - value) / 512 AS bh FROM frames),
n AS (SELECT video_id, count(*) AS n FROM d GROUP BY video_id),
s AS (SELECT video_id, -1 AS f, CAST([] AS {_TRACKS}) AS tracks, 0 AS next_id, CAST([] AS {_POINT}) AS points FROM n
  UNION ALL
  SELECT video_id, f,
    list_concat(list_filter(list_transform(predicted, lambda t: CASE WHEN t.id = hit THEN {updated} ELSE {aged} END), lambda t: t.inactive < 10), CASE WHEN hit = next_id THEN [{born}] ELSE CAST([] AS {_TRACKS}) END) AS tracks,
    next_id + CASE WHEN hit = next_id THEN 1 ELSE 0 END AS next_id,
    list_concat(CASE WHEN hit IS NULL THEN CAST([] AS {_POINT}) ELSE [{seen}] END, list_transform(list_filter(predicted, lambda t: t.hits >= 3 AND t.id IS DISTINCT FROM hit), lambda t: {coasting})) AS points
  FROM (SELECT *, CASE WHEN cx IS NULL THEN NULL ELSE coalesce(list_aggregate(list_transform(list_filter(list_transform(predicted, lambda t: {{'far': {far}, 'id': t.id}}), lambda z: z.far < 120), lambda z: z), 'min').id, next_id) END AS hit
    FROM (SELECT *, list_transform(tracks, lambda t: {predicted}) AS predicted
      FROM (SELECT s.video_id, s.f + 1 AS f, s.tracks, s.next_id, (s.f + 1) / 30.0::DOUBLE AS now, d.cx, d.cy, d.bw, d.bh FROM s JOIN n ON n.video_id = s.video_id LEFT JOIN d ON d.video_id = s.video_id AND d.frame_idx = s.f + 1
        WHERE s.f + 1 < n.n OR (s.f + 1 < n.n + {idle} AND len(s.tracks) > 0)))))
{last}"""


def _one_box(spark, sf_dir, idle: int) -> tuple[DataFrame, DataFrame]:
    rows = _frames(spark, sf_dir)
    x, y = F.col("value") % 100 * 6, F.col("value")
    boxes = rows.select("video_id", "frame_idx", (F.col("frame_idx") / 30.0).alias("timestamp"), F.lit(0).alias("det_idx"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 20).alias("y2"), F.lit(0.5).alias("confidence"), F.lit(32).alias("class_id"))
    videos = boxes.groupBy("video_id").agg((F.count("*") + idle).cast("int").alias("frame_count")).select("video_id", F.lit(30.0).alias("fps"), F.lit(640).alias("width"), F.lit(512).alias("height"), "frame_count")
    return boxes, videos


@query(_track_sql(15, f"SELECT video_id, f AS frame_idx, {_r4('f / 30.0::DOUBLE')} AS timestamp, p.track_id, p.x AS pos_x, p.y AS pos_y, p.confidence, p.synthetic AS is_interpolated FROM (SELECT video_id, f, unnest(points) AS p FROM s)"))
def track_points(spark, sf_dir):
    """Every user is a video with a box a frame and idle frames at its end, in which confirmed tracks coast and die."""
    return tracking.track(*_one_box(spark, sf_dir, 15), stride=1)


_STATES = """SELECT video_id, t.id AS track_id, CASE WHEN t.hits >= 3 THEN 'CONFIRMED' ELSE 'TENTATIVE' END AS state, t.hits, t.inactive, round(t.x, 6) AS pred_x, round(t.y, 6) AS pred_y, round(t.vx, 6) + 0.0::DOUBLE AS vel_x, round(t.vy, 6) + 0.0::DOUBLE AS vel_y, round(t.w, 6) AS size_w, round(t.h, 6) AS size_h
FROM (SELECT video_id, unnest(tracks) AS t FROM (SELECT video_id, max_by(tracks, f) AS tracks FROM s GROUP BY video_id))"""


def _states(spark, sf_dir) -> DataFrame:
    out = tracking.track_states(*_one_box(spark, sf_dir, 0), stride=1)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("pred_x", "pred_y", "vel_x", "vel_y", "size_w", "size_h")})


@query(_track_sql(0, _STATES))
def track_snapshot(spark, sf_dir):
    """All tracks that live at a video's end."""
    return _states(spark, sf_dir)


@query(_track_sql(0, f"SELECT video_id, track_id, hits FROM ({_STATES}) WHERE state = 'CONFIRMED'"))
def confirmed_tracks(spark, sf_dir):
    return _states(spark, sf_dir).where("state = 'CONFIRMED'").select("video_id", "track_id", "hits")


@query(_track_sql(0, f"SELECT video_id, track_id, round(greatest(0, least(1, pred_x + vel_x * 0.1)), 4) AS x, round(greatest(0, least(1, pred_y + vel_y * 0.1)), 4) AS y FROM ({_STATES})"))
def track_predictions(spark, sf_dir):
    """Where each live track should be a tenth of a second on, clamped, without gravity."""
    ahead = lambda p, v: F.round(scalar.clamp01(F.col(p) + F.col(v) * 0.1), 4)
    return _states(spark, sf_dir).select("video_id", "track_id", ahead("pred_x", "vel_x").alias("x"), ahead("pred_y", "vel_y").alias("y"))


@query(f"""WITH {FRAMES}, g AS (SELECT video_id, frame_idx, event_id % 4 AS tracks, event_id % 3 AS predictions, event_id % 2 AS detections FROM frames)
SELECT video_id, frame_idx, frame_idx % 30 = 0 OR tracks = 0 OR predictions = 0 AS "full", NOT (frame_idx % 30 = 0 OR tracks = 0 OR predictions = 0) AND (detections = 0 OR frame_idx % 5 = 0) AS again FROM g""")
def scan_modes(spark, sf_dir):
    rows = _frames(spark, sf_dir).select("video_id", "frame_idx", (F.col("event_id") % 4).alias("tracks"), (F.col("event_id") % 3).alias("predictions"), (F.col("event_id") % 2).alias("detections"))
    return tracking.scan_mode(rows, rescan=5).select("video_id", "frame_idx", "full", "again")


@query(f"""WITH RECURSIVE {FRAMES}, g AS (SELECT user_id, frame_idx, CASE WHEN event_type <> 'view' THEN value END AS a FROM frames),
s AS (SELECT user_id, -1 AS f, NULL::DOUBLE AS x, NULL::DOUBLE AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM (SELECT DISTINCT user_id FROM g)
  UNION ALL SELECT s.user_id, s.f + 1, CASE WHEN a IS NOT NULL THEN a ELSE x + vx END, CASE WHEN a IS NOT NULL THEN a * 2 ELSE y + vy END,
    CASE WHEN a IS NOT NULL AND x IS NOT NULL THEN (a - x) * 0.5 + vx * 0.5 ELSE vx END, CASE WHEN a IS NOT NULL AND x IS NOT NULL THEN (a * 2 - y) * 0.5 + vy * 0.5 WHEN a IS NULL AND x IS NOT NULL THEN vy + 1 ELSE vy END
  FROM s JOIN g ON g.user_id = s.user_id AND g.frame_idx = s.f + 1)
SELECT user_id, f AS frame_idx, CAST(floor(x * 1000 + 0.37) AS BIGINT) AS x_milli, CAST(floor(y * 1000 + 0.37) AS BIGINT) AS y_milli FROM s WHERE f >= 0""")
def coasting(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumn("a", F.when(F.col("event_type") != "view", F.col("value")))
    out = tracking.coast(rows.withColumn("b", F.col("a") * 2), ["user_id"], "frame_idx", "a", "b")
    return out.select("user_id", "frame_idx", *[F.floor(F.col(c) * 1000 + 0.37).cast("long").alias(f"{c}_milli") for c in ("x", "y")])


# history


@query("""SELECT o_custkey AS user_id, o_orderkey AS session_uuid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY 1000 + o_totalprice % 100, o_orderkey) AS INTEGER) AS place, CAST(coalesce((SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS BIGINT) AS total_throws FROM orders""")
def history_order(spark, sf_dir):
    sessions, items = _sessions(spark, sf_dir)
    return history.placed(history.history(sessions.withColumn("start_time", F.lit(1000.0) + F.col("end_time") % 100), items)).select("user_id", "session_uuid", "place", "total_throws")


@query(f"WITH {SIGNAL} SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, arg_min(value, (t, event_id)) AS value FROM signal GROUP BY user_id")
def first_rows(spark, sf_dir):
    return history.first_rows(signal(spark, sf_dir), ["user_id"], ["t", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_mktsegment AS email FROM customer")
def all_users(spark, sf_dir):
    path = new_path(spark, "users")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"))
    users.write.parquet(path)
    return history.all_users(spark.read.parquet(path))


@query("SELECT o_orderkey, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority)) AS session_uuid FROM orders")
def session_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", history.session_key("o_custkey", "o_orderkey", "o_orderpriority").alias("session_uuid"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS session_uuid, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_events, CASE WHEN o_orderkey % 3 = 2 THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) ELSE 0 END AS n_runs FROM orders""")
def inserted_sessions(spark, sf_dir):
    """Sessions in two inserts, the second of which repeats a part of the first: nothing of it is added again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_uuid"), F.col("o_orderkey").alias("k"))
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_uuid"), F.col("l_orderkey").alias("k"), "l_linenumber")
    part = lambda df, keep: df.where(keep).drop("k")
    have = part(o, "k % 3 < 2"), part(item, "k % 3 < 2"), part(item, "false")
    sessions, marks, streaks = history.insert_session(*have, part(o, "k % 3 > 0"), part(item, "k % 3 > 0"), part(item, "k % 3 > 0"))
    count = lambda df, name: df.groupBy("session_uuid").agg(F.count("*").alias(name))
    return sessions.join(count(marks, "n_events"), "session_uuid", "left").join(count(streaks, "n_runs"), "session_uuid", "left").na.fill(0)


# commands


_SPOKEN = {"ball": ["that", "with"], "background": [["for", "was"]], "reset": ["er the"]}
_SAID = "(contains(lower(text), 'that') OR contains(lower(text), 'with')) AS ball, contains(lower(text), 'for') AND contains(lower(text), 'was') AS background, contains(lower(text), 'er the') AS reset"


@query(f"SELECT conv_id, turn, {_SAID} FROM conversations")
def voice_commands(spark, sf_dir):
    """The rules of voice commands on words that the conversations hold."""
    return commands.commands(table(spark, sf_dir, "conversations"), words=_SPOKEN).select("conv_id", "turn", "ball", "background", "reset")


@query(f"SELECT conv_id, max_by(text, turn) AS last_command FROM (SELECT *, {_SAID} FROM conversations) WHERE ball OR background OR reset GROUP BY conv_id")
def last_command(spark, sf_dir):
    return commands.last_command(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", words=_SPOKEN)


@query(f"""WITH c AS (SELECT conv_id, turn, {_SAID} FROM conversations), f AS (SELECT conv_id, turn AS frame, lag(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn % 2 = 1)
SELECT f.conv_id, f.frame, coalesce(bool_or(ball), false) AS ball, coalesce(bool_or(background), false) AS background, coalesce(bool_or(reset), false) AS reset FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND c.turn <= f.frame AND c.turn > f.before GROUP BY f.conv_id, f.frame""")
def consumed_commands(spark, sf_dir):
    """Every other turn is a frame, which takes the commands since the frame before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("timestamp"), "text")
    frames = rows.where("timestamp % 2 = 1").select("conv_id", "timestamp")
    return commands.consumed(frames, rows, ["conv_id"], words=_SPOKEN).select("conv_id", F.col("timestamp").alias("frame"), "ball", "background", "reset")


@query(f"""WITH RECURSIVE {FRAMES}, s AS (SELECT user_id, -1 AS f, 0 AS chunk, 0 AS next_chunk, 0.0::DOUBLE AS held FROM (SELECT DISTINCT user_id FROM frames)
  UNION ALL SELECT s.user_id, s.f + 1, next_chunk, CASE WHEN held + value > 300 THEN next_chunk + 1 ELSE next_chunk END, CASE WHEN held + value > 300 THEN 0 ELSE held + value END FROM s JOIN frames g ON g.user_id = s.user_id AND g.frame_idx = s.f + 1)
SELECT user_id, f AS frame_idx, chunk FROM s WHERE f >= 0""")
def audio_buffers(spark, sf_dir):
    return live.audio_chunks(_frames(spark, sf_dir), ["user_id"], "frame_idx", "value", 300.0)


# pixels: an embedding is a picture of 8 x 8


def _pictures(spark, sf_dir, of, out: str) -> DataFrame:
    """vec_id and what `of` makes of the grey picture, as lists."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            made = [of(np.array(v, np.float64).reshape(8, 8)) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.ravel(m).tolist() for m in made])], ["vec_id", "out"])

    grey = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100) + 128)
    return table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("v")).mapInArrow(run, f"vec_id long, out array<{out}>")


PIXELS = "px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor(CAST(v AS DOUBLE) * 100) + 128 AS g FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query(f"""WITH {PIXELS}, k AS (SELECT * FROM (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, 1), (4, 1, 1), (5, 1, 0), (6, 1, -1), (7, 0, -1)) AS t(bit, dy, dx)),
c AS (SELECT a.vec_id, a.y, a.x, CAST(sum(CASE WHEN b.g >= a.g THEN 1 << bit ELSE 0 END) AS INTEGER) AS code FROM px a, k JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL),
e AS (SELECT vec_id, code FROM c UNION ALL SELECT vec_id, 0 FROM px WHERE y IN (0, 7) OR x IN (0, 7))
SELECT vec_id, code, count(*) AS n FROM e GROUP BY ALL""")
def lbp_histogram(spark, sf_dir):
    codes = _pictures(spark, sf_dir, lambda g: signature.lbp(g).astype(int), "long")
    return codes.select("vec_id", F.explode(F.col("out").cast("array<int>")).alias("code")).groupBy("vec_id", "code").agg(F.count("*").alias("n"))


@query(f"WITH {PIXELS} SELECT vec_id, round(avg(g), 6) AS mean FROM px WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 7 GROUP BY vec_id")
def region_mean(spark, sf_dir):
    out = _pictures(spark, sf_dir, lambda g: vision.mean_in(g, (1, 2, 6, 4)), "double")
    return out.select("vec_id", F.round(F.get("out", F.lit(0)), 6).alias("mean"))


@query(f"WITH {PIXELS} SELECT vec_id, list(g ORDER BY y, 7 - x) AS mirrored FROM px GROUP BY vec_id")
def mirrored_picture(spark, sf_dir):
    return _pictures(spark, sf_dir, vision.mirrored, "double").select("vec_id", F.col("out").alias("mirrored"))


@query("""SELECT vec_id, list_transform(range(32), lambda i: CAST(trunc(greatest(-1, least(1, (CAST(embedding[2 * i + 1] AS DOUBLE) + CAST(embedding[2 * i + 2] AS DOUBLE)) / 2)) * 32767) AS INTEGER)) AS samples FROM embeddings""")
def mono_samples(spark, sf_dir):
    """The components as two interleaved channels of sound."""

    def run(batches):
        for batch in batches:
            made = [vision.mono16(np.array(v, np.float64), 2).astype(np.int32) for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array([m.tolist() for m in made], pa.list_(pa.int32()))], ["vec_id", "samples"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, samples array<int>")


# signatures


@query("""WITH s AS (SELECT 'part' || p_size AS label, p_partkey FROM part), k AS (SELECT DISTINCT label, 100 + CAST(substr(label, 5) AS INTEGER) AS class_id FROM s WHERE CAST(substr(label, 5) AS INTEGER) <= 9),
f AS (SELECT label, CAST((SELECT max(class_id) + 1 FROM k) + row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id FROM (SELECT DISTINCT label FROM s WHERE label NOT IN (SELECT label FROM k)))
SELECT p_partkey, label, class_id FROM s JOIN (SELECT * FROM k UNION ALL SELECT * FROM f) USING (label)""")
def registered_classes(spark, sf_dir):
    samples = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), F.col("p_size").cast("string")).alias("label"), "p_partkey", "p_size")
    known = samples.where("p_size <= 9").select("label", (F.col("p_size") + 100).cast("int").alias("class_id")).distinct()
    return signature.register(samples.drop("p_size"), known).select("p_partkey", "label", "class_id")


@query("SELECT CAST(label AS VARCHAR) AS label, CAST(any_value(label) AS INTEGER) AS class_id, count(*) AS sample_count, bool_or(vec_id % 3 = 0) AS has_color, bool_or(false) AS has_texture FROM embeddings GROUP BY label")
def registration_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    samples = e.select(F.col("label").cast("string").alias("label"), F.col("label").cast("int").alias("class_id"), F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).alias("color"), F.lit(None).cast("array<float>").alias("texture"))
    return signature.registration_info(samples)


@query("""WITH p AS (SELECT label, unnest(embedding) AS v FROM embeddings), h AS (SELECT label, CAST(floor(floor((CAST(v AS DOUBLE) + 1) * 90) * 36 / 180) AS INTEGER) AS bin, count(*) AS n FROM p WHERE floor((CAST(v AS DOUBLE) + 1) * 90) >= 0 AND floor((CAST(v AS DOUBLE) + 1) * 90) < 180 GROUP BY ALL) SELECT * FROM h""")
def background_histogram(spark, sf_dir):
    """All pixels of a frame, however saturated, by hue."""
    pixels = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")).select("label", F.floor((F.col("v").cast("double") + 1) * 90).alias("hue"))
    return signature.hue_histogram(pixels, ["label"], "hue", None)


# streams


@query(_RUNS + f" SELECT * FROM runs WHERE end_time + {RUN_GAP} - 1 <= (SELECT max(t) FROM signal) - {24 * HOUR}")
def stream_closed_runs(spark, sf_dir):
    """Append mode: the runs that the watermark has passed."""
    found = _to_table(live.stream_runs(_stream(spark, sf_dir), ["user_id"], "at", RUN_GAP), "closed-runs", "append")
    return found.select("user_id", F.unix_micros("start_time").alias("start_time"), F.unix_micros("end_time").alias("end_time"), "n_events")
