"""Queries over frames, detections and tracks: fusion, tracking, motion and occupants."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanweave.functions.scratch import written
from scanweave.operators import filters as fl
from scanweave.operators import fusion as fu
from scanweave.operators import geometry as ge
from scanweave.operators import motion as mo
from scanweave.operators import occupants as oc
from scanweave.operators import select as se
from scanweave.operators import stats as st
from scanweave.operators import tracking as tr

from . import fixtures as fx
from .fixtures import KEYS, TRACK_KEYS, oracle
from .scene import _dbscan_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
FRAME = ["device_no", "scan_idx"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def _r(*columns: str, places: int = 6) -> list:
    return [F.round(c, places).alias(c) for c in columns]


def _boxes_in_view(spark, sf):
    """All detections, placed in the frames of the point clouds: every fifth frame is one scan's."""
    d = fx.detections(spark, sf)
    return d.select("device_no", F.expr("det_id DIV 10000 * 5 + frame_id % 5").alias("scan_idx"), "camera", "det_id", "confidence", "x1", "y1", "x2", "y2", "frame_id", "sequence_no")


_SHOT = """shot AS (SELECT device_no, scan_idx, camera, point_id, x, y, z, r31*x + r32*y + r33*z + t3 AS depth,
  CASE WHEN r31*x + r32*y + r33*z + t3 > 0 THEN CAST(fx*(r11*x + r12*y + r13*z + t1)/(r31*x + r32*y + r33*z + t3) + cx0 AS FLOAT) END AS u,
  CASE WHEN r31*x + r32*y + r33*z + t3 > 0 THEN CAST(fy*(r21*x + r22*y + r23*z + t2)/(r31*x + r32*y + r33*z + t3) + cy0 AS FLOAT) END AS v FROM pts JOIN cal USING (device_no)),
view AS (SELECT device_no, det_id // 10000 * 5 + frame_id % 5 AS scan_idx, camera, det_id, confidence, x1, y1, x2, y2 FROM det),
onbox AS (SELECT s.*, det_id FROM shot s JOIN view USING (device_no, scan_idx, camera) WHERE depth > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1200 AND u BETWEEN x1 AND x2 AND v BETWEEN y1 AND y2),
fused AS (SELECT v.device_no, v.scan_idx, v.camera, v.det_id, coalesce(n, 0) AS n_points, coalesce(d0, 0) AS depth_min, coalesce(d1, 0) AS depth_max, mx, my, mz, extent_x, extent_y, extent_z FROM view v
  LEFT JOIN (SELECT det_id, count(*) AS n, min(depth) AS d0, max(depth) AS d1, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, max(x) - min(x) AS extent_x, max(y) - min(y) AS extent_y, max(z) - min(z) AS extent_z FROM onbox GROUP BY det_id) USING (det_id))"""


def _shot(spark, sf):
    return ge.projected(fu.with_calibration(fx.points(spark, sf), spark.sql(fx.CALIBRATION)))


def _fused(spark, sf):
    view = _boxes_in_view(spark, sf)
    return fu.fused_detections(fu.attached(_shot(spark, sf), view, FRAME), view, FRAME)


@query("SELECT frame_id, device_no, sequence_no, det_id FROM det WHERE frame_id BETWEEN 5 AND 20 AND camera = 'cam1' AND device_no = 1")
def f7_frame_selection(spark, sf):
    return fl.frame_selection(fx.detections(spark, sf), 5, 20, ["cam1"], device_no=1).select("frame_id", *TRACK_KEYS, "det_id")


@query("SELECT * FROM frm WHERE sync_quality IN ('good', 'excellent')")
def f8_sync_filter(spark, sf):
    return fl.sync_filter(fx.frames(spark, sf), "good")


@query(f"{_SHOT}\nSELECT point_id, camera, round(CAST(u AS DOUBLE), 2) AS u, round(CAST(v AS DOUBLE), 2) AS v, round(depth, 6) AS depth FROM shot WHERE depth > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1200")
def p8_f9_f10_projection(spark, sf):
    seen = fl.in_front(_shot(spark, sf)).where(fl.in_image())
    return seen.select("point_id", "camera", F.round(F.col("u").cast("double"), 2).alias("u"), F.round(F.col("v").cast("double"), 2).alias("v"), *_r("depth"))


@query("SELECT det_id, (x1 + x2)/2 AS bx, (y1 + y2)/2 AS by, x2 - x1 AS bw, y2 - y1 AS bh, CAST(greatest(x1 - 20, 0) AS INT) AS crop_x1, CAST(greatest(y1 - 20, 0) AS INT) AS crop_y1, CAST(least(x2 + 20, 1920) AS INT) AS crop_x2, CAST(least(y2 + 20, 1200) AS INT) AS crop_y2 FROM det")
def p15_box_geometry(spark, sf):
    return ge.box_geometry(fx.detections(spark, sf)).select("det_id", "bx", "by", "bw", "bh", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(f"{_SHOT}\nSELECT point_id, det_id FROM onbox")
def j2_points_on_boxes(spark, sf):
    return fu.attached(_shot(spark, sf), _boxes_in_view(spark, sf), FRAME).select("point_id", "det_id")


_FUSED = ("depth_min", "depth_max", "depth_mean", "mx", "my", "mz", "extent_x", "extent_y", "extent_z")


@query(_SHOT + "\nSELECT device_no, scan_idx, det_id, n_points, round((depth_min + depth_max)/2, 6) AS depth_mean, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FUSED if c != "depth_mean") + " FROM fused")
def a11_fused_detections(spark, sf):
    """A11 and A13."""
    return _fused(spark, sf).select(*FRAME, "det_id", "n_points", *_r(*_FUSED))


_SUMMARY = f"""{_SHOT},
total AS (SELECT device_no, scan_idx, camera, count(*) AS total, count(*) FILTER (WHERE depth > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1200) AS projected FROM shot GROUP BY ALL),
boxes AS (SELECT device_no, scan_idx, camera, count(*) AS detections, CAST(sum(n_points) AS BIGINT) AS on_boxes FROM fused GROUP BY ALL),
fr AS (SELECT DISTINCT device_no, det_id // 10000 * 5 + frame_id % 7 AS scan_idx FROM det)"""


@query(f"""{_SUMMARY}
SELECT fr.device_no, fr.scan_idx, c.camera, coalesce(total, 0) AS total, coalesce(projected, 0) AS projected, coalesce(detections, 0) AS detections, coalesce(on_boxes, 0) AS on_boxes,
  round(100::DOUBLE*projected/total, 6) AS projected_percent, round(100::DOUBLE*on_boxes/projected, 6) AS on_boxes_percent, total IS NOT NULL AS processing_success, CASE WHEN total IS NULL THEN 'no points' END AS error
FROM fr JOIN (SELECT device_no, camera FROM cal) c USING (device_no) LEFT JOIN total t USING (device_no, scan_idx, camera) LEFT JOIN boxes USING (device_no, scan_idx, camera)""")
def m15_fusion_job(spark, sf):
    job = fu.fusion_job(*_job_inputs(spark, sf), FRAME)
    return job.select(*FRAME, "camera", "total", "projected", "detections", "on_boxes", *_r("projected_percent", "on_boxes_percent"), "processing_success", "error")


def _job_inputs(spark, sf):
    """Frames of which the last two have no points."""
    frames = fx.detections(spark, sf).select("device_no", F.expr("det_id DIV 10000 * 5 + frame_id % 7").alias("scan_idx")).distinct()
    return frames, fx.points(spark, sf), spark.sql(fx.CALIBRATION), _boxes_in_view(spark, sf)


@query(f"""{_SUMMARY},
job AS (SELECT c.camera, coalesce(projected, 0) AS projected, coalesce(on_boxes, 0) AS on_boxes, total IS NOT NULL AS ok
  FROM fr JOIN (SELECT device_no, camera FROM cal) c USING (device_no) LEFT JOIN total USING (device_no, scan_idx, camera) LEFT JOIN boxes USING (device_no, scan_idx, camera))
SELECT coalesce(camera, 'all') AS camera, count(*) AS frames, count(*) FILTER (WHERE ok) AS ok, CAST(sum(on_boxes) AS BIGINT) AS on_boxes, round(avg(projected), 6) AS mean_projected FROM job GROUP BY ROLLUP (camera)""")
def a14_batch_rollup(spark, sf):
    return fu.batch_rollup(fu.fusion_job(*_job_inputs(spark, sf), FRAME)).select("camera", "frames", "ok", "on_boxes", *_r("mean_projected"))


@query(f"{_SHOT}\nSELECT device_no, scan_idx, CAST(sum(n_points) FILTER (WHERE camera = 'cam0') AS BIGINT) AS cam0, CAST(sum(n_points) FILTER (WHERE camera = 'cam1') AS BIGINT) AS cam1 FROM fused GROUP BY ALL")
def j12_camera_comparison(spark, sf):
    return fu.camera_comparison(_fused(spark, sf), FRAME)


@query(f"{_SHOT}\nSELECT device_no, scan_idx, camera, det_id, n_points FROM fused WHERE n_points > 0 ORDER BY device_no, scan_idx, camera, det_id LIMIT 40")
def t9_good_detections(spark, sf):
    return fu.good_detections(_fused(spark, sf), FRAME, 0, 40).select(*FRAME, "camera", "det_id", "n_points")


@query(f"""{_SHOT}
SELECT device_no, scan_idx, camera, det_id, n_points FROM (SELECT *, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY camera, det_id) AS k FROM fused) WHERE k = 1 AND n_points >= 0""")
def t9_first_camera(spark, sf):
    return fu.first_camera_detections(_fused(spark, sf), FRAME, -1).select(*FRAME, "camera", "det_id", "n_points")


@query("SELECT sequence_no, camera, det_id FROM (SELECT *, row_number() OVER (PARTITION BY sequence_no, camera ORDER BY ts, det_id) AS k FROM det) WHERE k <= 4")
def t8_first_detections(spark, sf):
    return se.first_n(fx.detections(spark, sf), ["sequence_no", "camera"], ["ts", "det_id"], 4).select("sequence_no", "camera", "det_id")


@query(f"""{_SHOT}, r AS (SELECT device_no, scan_idx, camera, min(depth) AS d0, max(depth) AS d1 FROM onbox GROUP BY ALL),
t AS (SELECT point_id, det_id, CASE WHEN d1 > d0 THEN (depth - d0)/(d1 - d0) END AS s FROM onbox JOIN r USING (device_no, scan_idx, camera))
SELECT point_id, det_id, round(s, 6) AS shade, coalesce(CAST(floor(255*(1 - s)) AS INT), 0) AS red, CASE WHEN s IS NULL THEN 255 ELSE 0 END AS green, coalesce(CAST(floor(255*s) AS INT), 0) AS blue FROM t""")
def p13_depth_shade(spark, sf):
    seen = ge.depth_colour(fu.attached(_shot(spark, sf), _boxes_in_view(spark, sf), FRAME), [*FRAME, "camera"])
    return seen.select("point_id", "det_id", *_r("shade"), "red", "green", "blue")


@query("SELECT device_no, sequence_no, count(*) AS frames, round(max(ts) - min(ts), 6) AS duration, arg_min(frame_id, ts) AS first_frame, arg_max(frame_id, ts) AS last_frame, count(*) FILTER (WHERE sync_quality = 'excellent') AS excellent FROM frm GROUP BY ALL")
def a15_sequence_catalogue(spark, sf):
    return fu.sequence_catalogue(fx.frames(spark, sf), TRACK_KEYS).select(*TRACK_KEYS, "frames", *_r("duration"), "first_frame", "last_frame", "excellent")


@query("SELECT device_no, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS frames, string_agg(DISTINCT frame_id, ',' ORDER BY frame_id) AS ids FROM frm GROUP BY ALL")
def a16_device_ranges(spark, sf):
    return fu.device_ranges(fx.frames(spark, sf)).withColumn("ids", F.array_join("ids", ","))


@query("SELECT camera, count(*) AS detections, count(DISTINCT sequence_no * 1000 + frame_id) AS frames_with, round(avg(n_points), 6) AS mean_points, (SELECT count(*) FROM frm) AS all_frames, round(count(DISTINCT sequence_no * 1000 + frame_id)/CAST((SELECT count(*) FROM frm) AS DOUBLE), 6) AS rate FROM det GROUP BY camera")
def a17_detection_rate(spark, sf):
    return fu.detection_rate(fx.frames(spark, sf), fx.detections(spark, sf), [*TRACK_KEYS, "frame_id"]).select("camera", "detections", "frames_with", *_r("mean_points"), "all_frames", *_r("rate"))


@query("e AS (SELECT device_no, sequence_no, frame_id, count(*) AS cars FROM det WHERE n_points > 10 GROUP BY ALL)\nSELECT *, frame_id = first_value(frame_id) OVER (PARTITION BY device_no, sequence_no ORDER BY cars DESC, frame_id) AS is_peak FROM e")
def a18_activity(spark, sf):
    return fu.activity(fx.detections(spark, sf).where("n_points > 10"), TRACK_KEYS)


@query("SELECT sequence_no, frame_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY sequence_no ORDER BY ts) AS k FROM frm) WHERE k <= 3 ORDER BY sequence_no, ts")
def t1_t2_first_frames(spark, sf):
    return se.first_n(fx.frames(spark, sf), ["sequence_no"], ["ts"], 3).select("sequence_no", "frame_id", "ts").orderBy("sequence_no", "ts")


@query("SELECT device_no, frame_id, det_id FROM (SELECT *, row_number() OVER (PARTITION BY device_no, frame_id ORDER BY det_id) AS k FROM det) WHERE k = 1")
def w9_first_per_frame(spark, sf):
    return se.first_n(fx.detections(spark, sf), ["device_no", "frame_id"], ["det_id"], 1).select("device_no", "frame_id", "det_id")


_SEGMENTS = """cut AS (SELECT *, CAST(sum(b) OVER (PARTITION BY device_no, sequence_no ORDER BY ts, camera, det_seq, det_id) AS BIGINT) AS segment_id FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_no, sequence_no ORDER BY ts, camera, det_seq, det_id) > 1 THEN 1 ELSE 0 END AS b FROM det))"""
#: In these detections an object keeps its number in a stretch, which makes the tracks known.
_TRACKS = f"""{_SEGMENTS},
trk AS (SELECT *, count(*) OVER (PARTITION BY device_no, sequence_no, segment_id, det_seq) AS n FROM cut),
ids AS (SELECT *, dense_rank() OVER (PARTITION BY device_no, sequence_no ORDER BY segment_id, camera, det_seq) - 1 AS track_id FROM trk WHERE n >= 2)"""


@query(f"{_SEGMENTS}\nSELECT det_id, segment_id FROM cut")
def w2_gap_segments(spark, sf):
    return tr.gap_segments(fx.detections(spark, sf), TRACK_KEYS).select("det_id", "segment_id")


@query(f"{_TRACKS}\nSELECT det_id, CAST(track_id AS INT) AS track_id FROM ids")
def m9_basic_tracker(spark, sf):
    return tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS).select("det_id", "track_id")


@query(f"""{_TRACKS}
SELECT device_no, sequence_no, CAST(track_id AS INT) AS track_id, count(*) AS n_detections, CAST(sum(n_points) AS BIGINT) AS n_points, round(max(ts) - min(ts), 6) AS duration, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras,
  round(avg(cx), 6) AS mx, round(avg(cy), 6) AS my, round(avg(cz), 6) AS mz, round(max(cx) - min(cx), 6) AS size_x, round(max(cy) - min(cy), 6) AS size_y, round(max(cz) - min(cz), 6) AS size_z, round(least(1::DOUBLE, sum(n_points)/100::DOUBLE*count(*)/5::DOUBLE), 6) AS quality FROM ids GROUP BY ALL""")
def a19_a20_track_summary(spark, sf):
    s = tr.track_summary(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return s.select(*TRACK_KEYS, "track_id", "n_detections", "n_points", *_r("duration"), "cameras", *_r("mx", "my", "mz", "size_x", "size_y", "size_z", "quality"))


_PER_TRACK = f"""{_TRACKS}, s AS (SELECT device_no, sequence_no, track_id, count(*) AS n_detections, max(ts) - min(ts) AS duration, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM ids GROUP BY ALL)"""


@query(f"""{_PER_TRACK}
SELECT device_no, count(*) AS tracks, round(avg(duration), 6) AS mean_duration, round(avg(n_detections), 6) AS mean_detections, (SELECT string_agg(DISTINCT camera, ',' ORDER BY camera) FROM ids i WHERE i.device_no = s.device_no) AS cameras FROM s GROUP BY device_no""")
def a19_track_analysis(spark, sf):
    s = tr.track_summary(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return tr.track_analysis(s, ["device_no"]).select("device_no", "tracks", *_r("mean_duration", "mean_detections"), "cameras")


@query(f"{_TRACKS}\nSELECT device_no, camera, count(DISTINCT sequence_no * 100000 + track_id) AS tracks FROM ids GROUP BY ALL")
def a19_tracks_by_camera(spark, sf):
    s = tr.track_summary(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return tr.tracks_by_camera(s, ["device_no"])


@query(f"""{_TRACKS}, s AS (SELECT device_no, sequence_no, track_id, count(*) AS n_detections, sum(n_points) AS n_points, least(1::DOUBLE, sum(n_points)/100::DOUBLE*count(*)/5::DOUBLE) AS quality FROM ids GROUP BY ALL)
SELECT count(*) AS cars, CAST(sum(n_detections) AS BIGINT) AS detections, CAST(sum(n_points) AS BIGINT) AS points, round(avg(quality), 6) AS mean_quality FROM s WHERE n_detections >= 3 AND n_points >= 20""")
def f12_a32_fleet(spark, sf):
    s = tr.track_summary(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return tr.fleet(fl.track_gate(s, 3, 20)).select("cars", "detections", "points", *_r("mean_quality"))


@query(f"""{_TRACKS}, s AS (SELECT device_no, sequence_no, CAST(track_id AS INT) AS track_id, count(*) AS n_detections, CAST(sum(n_points) AS BIGINT) AS n_points FROM ids GROUP BY ALL)
SELECT device_no, track_id, sequence_no, n_detections * n_points AS score FROM (SELECT *, row_number() OVER (PARTITION BY device_no, sequence_no ORDER BY n_detections * n_points DESC, track_id) AS k FROM s) WHERE k = 1""")
def t3_best_model(spark, sf):
    s = tr.track_summary(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return se.best_model(s, TRACK_KEYS, F.col("n_detections") * F.col("n_points")).select(*TRACK_KEYS, "track_id", "score")


@query(f"""{_TRACKS}, w AS (SELECT *, lag(cx) OVER o AS px, lag(cy) OVER o AS py, lag(ts) OVER o AS pt, min(ts) OVER (PARTITION BY device_no, sequence_no, track_id) AS t0 FROM ids WINDOW o AS (PARTITION BY device_no, sequence_no, track_id ORDER BY ts, det_id))
SELECT det_id, round(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)), 6) AS step, round(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py))/(ts-pt), 4) AS speed, round(ts - t0, 6) AS since FROM w""")
def w5_w8_trajectories(spark, sf):
    t = tr.trajectories(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return t.select("det_id", *_r("step"), *_r("speed", places=4), *_r("since"))


@query(f"""{_TRACKS}, w AS (SELECT *, row_number() OVER o AS det_ordinal, CAST(sum(n_points) OVER o AS BIGINT) AS cumulative, max(confidence) OVER o AS best_confidence, max(cx) OVER o - min(cx) OVER o AS dx,
  sum(n_points) OVER (PARTITION BY device_no, sequence_no, track_id) AS total FROM ids WINDOW o AS (PARTITION BY device_no, sequence_no, track_id ORDER BY ts, det_id))
SELECT det_id, CAST(det_ordinal AS INT) AS det_ordinal, cumulative, best_confidence, round(cumulative/greatest(1::DOUBLE, CASE WHEN dx > 0 THEN dx ELSE 1 END), 5) AS density, round(least(1::DOUBLE, cumulative/100::DOUBLE), 6) AS quality, CASE WHEN total > 0 THEN round(100*(cumulative/CAST(total AS DOUBLE)), 6) END AS completeness FROM w""")
def w3_w6_accumulation(spark, sf):
    a = tr.accumulation(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS)
    return a.select("det_id", "det_ordinal", "cumulative", "best_confidence", *_r("density", places=5), *_r("quality", "completeness"))


@query(f"""{_TRACKS}, w AS (SELECT device_no, sequence_no, track_id, sum(n_points) OVER (PARTITION BY device_no, sequence_no, track_id ORDER BY ts, det_id) AS cumulative, row_number() OVER (PARTITION BY device_no, sequence_no, track_id ORDER BY ts, det_id) AS step FROM ids)
SELECT device_no, sequence_no, CAST(track_id AS INT) AS track_id, round((arg_max(cumulative, step) - arg_min(cumulative, step))/CAST(count(*) - 1 AS DOUBLE), 6) AS growth FROM w GROUP BY ALL""")
def a34_growth(spark, sf):
    a = tr.accumulation(tr.basic_tracks(fx.detections(spark, sf), TRACK_KEYS), TRACK_KEYS).withColumn("step", F.col("det_ordinal"))
    return st.growth_rate(a, [*TRACK_KEYS, "track_id"]).select(*TRACK_KEYS, "track_id", *_r("growth"))


@query("SELECT det_id, round((ts - min(ts) OVER (PARTITION BY sequence_no))/(max(ts) OVER (PARTITION BY sequence_no) - min(ts) OVER (PARTITION BY sequence_no) + 1e-6::DOUBLE), 6) AS age FROM det")
def w7_age(spark, sf):
    return tr.with_age(fx.detections(spark, sf), ["sequence_no"]).select("det_id", *_r("age"))


_NEAR = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


def _with_points(spark, sf):
    """Each detection carries eight points around its centre, which move with it, one of them astray."""
    d = fx.detections(spark, sf)
    x = lambda k: F.col("cx") + k * 0.1 + F.when((k == 7) & (F.col("det_id") % 3 == 0), 1.5).otherwise(0.0)
    near = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct(x(k).alias("x"), F.col("cy").alias("y"), (F.col("cz") + (k % 2) * 0.2).alias("z")))
    return d.withColumn("points", near)


def _models_sql() -> str:
    """``model``: of each track its last state, by a recursion over the frames of each object. Objects stand ten metres apart, and an object that has left
    its track behind moves on; so a detection can only join the last track of its own object."""
    axes = "xyz"
    mean = lambda xs, a: f"list_avg(list_transform({xs}, lambda q: q.{a}))"
    d2 = lambda p, q: " + ".join(f"({p}.{a} - {q}.{a})*({p}.{a} - {q}.{a})" for a in axes)
    mid = ", ".join(f"'{a}': list_median(list_transform(points, lambda q: q.{a}))" for a in axes)
    return f"""eight AS (SELECT sequence_no, device_no, det_seq, det_id, ts, camera, frame_id, list_transform(range(0, 8), lambda k: {{'x': cx + k*0.1::DOUBLE + CASE WHEN k = 7 AND det_id % 3 = 0 THEN 1.5::DOUBLE ELSE 0 END, 'y': cy, 'z': cz + (k % 2)*0.2::DOUBLE}}) AS points FROM det),
away AS (SELECT *, list_transform(points, lambda p: sqrt({d2("p", "mid")})) AS far FROM (SELECT *, {{{mid}}} AS mid FROM eight)),
clean AS (SELECT sequence_no, device_no, det_seq, det_id, ts, camera, frame_id, {", ".join(f"{mean('points', a)} AS m{a}" for a in axes)},
  list_transform(list_filter(list_zip(points, far), lambda t: t[2] <= list_avg(far) + 2*list_stddev_pop(far)), lambda t: t[1]) AS points FROM away),
step AS (SELECT *, row_number() OVER (PARTITION BY device_no, sequence_no, det_seq ORDER BY ts, det_id) AS k FROM clean),
run AS (SELECT device_no, sequence_no, det_seq, k, ts, camera, det_id AS born, ts AS start, 1 AS times, points AS cloud FROM step WHERE k = 1
  UNION ALL
  SELECT device_no, sequence_no, det_seq, k, ts, camera, CASE WHEN hit THEN born ELSE det_id END, CASE WHEN hit THEN start ELSE ts END, CASE WHEN hit THEN times + 1 ELSE 1 END,
    CASE WHEN hit THEN list_concat(cloud, list_filter(points, lambda p: list_min(list_transform(cloud, lambda q: {d2("p", "q")})) > 0.05::DOUBLE*0.05::DOUBLE)) ELSE points END
  FROM (SELECT s.*, r.born, r.start, r.times, r.cloud, s.ts - r.ts <= 1.5::DOUBLE AND sqrt({" + ".join(f"({mean('r.cloud', a)} - s.m{a})*({mean('r.cloud', a)} - s.m{a})" for a in axes)}) <= 3 AS hit
    FROM run r JOIN step s ON s.device_no = r.device_no AND s.sequence_no = r.sequence_no AND s.det_seq = r.det_seq AND s.k = r.k + 1)),
model AS (SELECT device_no, sequence_no, born, max(start) AS start, max(ts) AS ts, max(camera) AS cameras, arg_max(cloud, times) AS cloud, max(times) AS times FROM run GROUP BY ALL),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.device_no, m.sequence_no ORDER BY d.ts, d.camera, d.det_seq, d.det_id) - 1 AS track_id FROM model m JOIN clean d ON d.det_id = m.born)"""


_OF = {a: f"list_transform(cloud, lambda q: q.{a})" for a in "xyz"}


@query("RECURSIVE " + _models_sql() + "\nSELECT device_no, sequence_no, CAST(track_id AS INT) AS track_id, times AS n_detections, len(cloud) AS n_points, round(ts - start, 6) AS duration, cameras, "
       + ", ".join(f"round(list_avg({x}), 6) AS centre_{a}, round(list_max({x}) - list_min({x}), 6) AS size_{a}" for a, x in _OF.items())
       + ", round(least(1::DOUBLE, len(cloud)/100::DOUBLE*times/5::DOUBLE), 6) AS quality FROM ranked WHERE times >= 2")
def m10_accumulating_tracker(spark, sf):
    d = _with_points(spark, sf)
    s = tr.model_summary(tr.accumulating_tracks(d, TRACK_KEYS), d, TRACK_KEYS)
    return s.select(*TRACK_KEYS, "track_id", "n_detections", "n_points", *_r("duration"), "cameras", *_r("centre_x", "centre_y", "centre_z", "size_x", "size_y", "size_z", "quality"))


_TURN = "fmod(atan2(p.y - h.y, p.x - h.x) - h.dir + 4*pi(), 2*pi())"


@query(f"""RECURSIVE v AS (SELECT device_no, scan_idx, x, y FROM pts WHERE semantic_class BETWEEN 1 AND 4),
enough AS (SELECT device_no, scan_idx, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 6),
pt AS (SELECT DISTINCT v.* FROM v SEMI JOIN enough USING (device_no, scan_idx)),
wrap AS (SELECT device_no, scan_idx, x, y, x AS sx, y AS sy, -pi()/2 AS dir, 0 AS k FROM pt QUALIFY row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY x, y) = 1
  UNION ALL
  SELECT device_no, scan_idx, x, y, sx, sy, dir, k FROM (SELECT h.device_no, h.scan_idx, p.x, p.y, h.sx, h.sy, atan2(p.y - h.y, p.x - h.x) AS dir, h.k + 1 AS k,
      row_number() OVER (PARTITION BY h.device_no, h.scan_idx ORDER BY {_TURN}, (p.x - h.x)*(p.x - h.x) + (p.y - h.y)*(p.y - h.y) DESC) AS best
    FROM wrap h JOIN pt p ON p.device_no = h.device_no AND p.scan_idx = h.scan_idx AND (p.x <> h.x OR p.y <> h.y) WHERE h.k = 0 OR h.x <> h.sx OR h.y <> h.sy) WHERE best = 1),
side AS (SELECT *, lag(x) OVER (PARTITION BY device_no, scan_idx ORDER BY k) AS px, lag(y) OVER (PARTITION BY device_no, scan_idx ORDER BY k) AS py FROM wrap)
SELECT device_no, scan_idx, CAST(max(k) AS BIGINT) AS corners, round(abs(sum(px*y - x*py))/2, 6) AS area FROM side GROUP BY ALL""")
def a31_footprints(spark, sf):
    return tr.footprints(fx.points(spark, sf).where("semantic_class between 1 and 4"), KEYS).select(*KEYS, "corners", *_r("area"))


def _static_sql(rounds: int = 3) -> str:
    """``stat``: the points that the pass in order of ids keeps, of scans thinned to voxels, with the share of scans near each. In each round the points
    without an undecided neighbour of a lower id are kept, and what is near them goes; chains of these scans are shorter than the rounds."""
    out = f"""low AS (SELECT device_no, scan_idx, min(x) - 0.05::DOUBLE AS lx, min(y) - 0.05::DOUBLE AS ly, min(z) - 0.05::DOUBLE AS lz FROM mov GROUP BY ALL),
thin AS (SELECT device_no, scan_idx, min(point_id) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM mov JOIN low USING (device_no, scan_idx)
  GROUP BY device_no, scan_idx, floor((x - lx)/0.1::DOUBLE), floor((y - ly)/0.1::DOUBLE), floor((z - lz)/0.1::DOUBLE)),
cellt AS (SELECT *, CAST(floor(x/0.05::DOUBLE) AS BIGINT) AS g FROM thin),
pair AS (SELECT a.point_id AS p, b.point_id AS q FROM (SELECT *, g + unnest([-1, 0, 1]) AS h FROM cellt) a JOIN cellt b ON a.device_no = b.device_no AND a.h = b.g AND a.point_id <> b.point_id AND {_NEAR} <= 0.05::DOUBLE*0.05::DOUBLE),
und0 AS (SELECT point_id FROM thin)"""
    for k in range(1, rounds + 1):
        out += f""",
keep{k} AS (SELECT point_id FROM und{k - 1} ANTI JOIN (SELECT p AS point_id FROM pair SEMI JOIN und{k - 1} u ON pair.q = u.point_id WHERE q < p) USING (point_id)),
und{k} AS (SELECT point_id FROM und{k - 1} ANTI JOIN keep{k} USING (point_id) ANTI JOIN (SELECT q AS point_id FROM pair SEMI JOIN keep{k} ON pair.p = keep{k}.point_id) USING (point_id))"""
    kept = " UNION ALL ".join(f"SELECT point_id FROM keep{k}" for k in range(1, rounds + 1))
    return out + f""",
kept AS ({kept}),
seen AS (SELECT p AS point_id, scan_idx FROM pair JOIN thin t ON pair.q = t.point_id UNION SELECT point_id, scan_idx FROM thin),
stat AS (SELECT t.*, count(DISTINCT s.scan_idx)/5::DOUBLE AS share FROM thin t SEMI JOIN kept USING (point_id) JOIN seen s ON s.point_id = t.point_id GROUP BY ALL)"""


@query(f"""{_static_sql()}
SELECT device_no, count(*) AS n, count(*) FILTER (WHERE share >= 0.7::DOUBLE) AS n_static, count(*) FILTER (WHERE share < 0.7::DOUBLE) AS n_dynamic, round(count(*) FILTER (WHERE share >= 0.7::DOUBLE)/count(*), 6) AS static_ratio FROM stat GROUP BY device_no""")
def m7_static_points(spark, sf):
    s = mo.static_points(fx.moving(spark, sf), ["device_no"])
    return mo.static_statistics(s, ["device_no"]).select("device_no", "n", "n_static", "n_dynamic", *_r("static_ratio"))


_NEAR_ENDS = f"""cell AS (SELECT *, CAST(floor(x/0.06::DOUBLE) AS BIGINT) AS g FROM mov), reach AS (SELECT *, CAST(floor(x/0.06::DOUBLE) AS BIGINT) + unnest([-1, 0, 1]) AS h FROM stat WHERE share < 0.7::DOUBLE),
near AS (SELECT a.device_no, a.point_id, b.scan_idx, arg_min(b.x, {_NEAR}) AS x, arg_min(b.y, {_NEAR}) AS y, arg_min(b.z, {_NEAR}) AS z FROM reach a JOIN cell b
  ON a.device_no = b.device_no AND a.h = b.g AND {_NEAR} <= 0.06::DOUBLE*0.06::DOUBLE GROUP BY ALL),
ends AS (SELECT device_no, point_id, count(*) AS found, arg_min(x, scan_idx) AS x0, arg_max(x, scan_idx) AS x1, arg_min(y, scan_idx) AS y0, arg_max(y, scan_idx) AS y1, arg_min(z, scan_idx) AS z0, arg_max(z, scan_idx) AS z1 FROM near GROUP BY ALL),
far AS (SELECT device_no, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) AS d FROM ends WHERE found >= 2)"""


@query(f"""{_static_sql()},
{_NEAR_ENDS},
dyn AS (SELECT device_no, count(*) AS n_dynamic FROM stat WHERE share < 0.7::DOUBLE GROUP BY ALL), mvd AS (SELECT device_no, count(*) AS n_moving, avg(d) AS mean, max(d) AS most FROM far WHERE d > 0.05::DOUBLE GROUP BY ALL)
SELECT device_no, n_dynamic, n_moving, round(mean, 6) AS mean_displacement, round(most, 6) AS max_displacement, round(n_moving/n_dynamic, 6) AS moving_ratio, round((n_dynamic - n_moving)/n_dynamic, 6) AS filtered FROM dyn JOIN mvd USING (device_no)""")
def m7_m8_temporal_change(spark, sf):
    """M7's dynamic points of all scans through M8 and its statistics."""
    m = fx.moving(spark, sf)
    dynamic = written(mo.static_points(m, ["device_no"]).where("not is_static"), "dynamic")
    s = mo.movement_statistics(mo.moving_points(dynamic, m, ["device_no"]), dynamic, ["device_no"])
    return s.select("device_no", "n_dynamic", "n_moving", *_r("mean_displacement", "max_displacement", "moving_ratio", "filtered"))




@query(f"""cell AS (SELECT *, CAST(floor(x/0.06::DOUBLE) AS BIGINT) AS g FROM mov), reach AS (SELECT *, g + unnest([-1, 0, 1]) AS h FROM cell),
near AS (SELECT a.device_no, a.point_id, b.scan_idx, arg_min(b.x, {_NEAR}) AS x, arg_min(b.y, {_NEAR}) AS y, arg_min(b.z, {_NEAR}) AS z FROM reach a JOIN cell b
  ON a.device_no = b.device_no AND a.h = b.g AND {_NEAR} <= 0.06::DOUBLE*0.06::DOUBLE GROUP BY ALL),
ends AS (SELECT device_no, point_id, count(*) AS found, arg_min(x, scan_idx) AS x0, arg_max(x, scan_idx) AS x1, arg_min(y, scan_idx) AS y0, arg_max(y, scan_idx) AS y1, arg_min(z, scan_idx) AS z0, arg_max(z, scan_idx) AS z1 FROM near GROUP BY ALL)
SELECT device_no, point_id, found, round(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)), 6) AS displacement FROM ends WHERE found >= 2 AND sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0)) > 0.05::DOUBLE""")
def m8_moving_points(spark, sf):
    """All points of all scans as the dynamic ones."""
    m = fx.moving(spark, sf)
    return mo.moving_points(m, m, ["device_no"]).select("device_no", "point_id", "found", *_r("displacement"))


@query("""d AS (SELECT device_no, count(*) AS n_dynamic FROM mov GROUP BY ALL), m AS (SELECT device_no, count(*) AS n_moving, avg(0.055::DOUBLE) AS mean FROM mov WHERE (point_id // 5) % 3 = 0 GROUP BY ALL)
SELECT device_no, n_dynamic, n_moving, round(mean, 6) AS mean_displacement, round(mean, 6) AS max_displacement, round(n_moving/n_dynamic, 6) AS moving_ratio, round((n_dynamic - n_moving)/n_dynamic, 6) AS filtered FROM d JOIN m USING (device_no)""")
def a22_a24_movement(spark, sf):
    m = fx.moving(spark, sf)
    s = mo.movement_statistics(mo.moving_points(m, m, ["device_no"]), m, ["device_no"])
    return s.select("device_no", "n_dynamic", "n_moving", *_r("mean_displacement", "max_displacement", "moving_ratio", "filtered"))


@query("SELECT device_no, scan_idx, count(*) AS n, count(*) FILTER (WHERE semantic_class = 3) AS n_human, round(avg(intensity/255) FILTER (WHERE semantic_class = 3), 6) AS mean_probability, round(100::DOUBLE*count(*) FILTER (WHERE semantic_class = 3)/count(*), 6) AS percent, count(*) FILTER (WHERE semantic_class = 3) > 50 AND coalesce(avg(intensity/255) FILTER (WHERE semantic_class = 3), 0) > 0.3 AS has_human FROM pts GROUP BY ALL")
def a25_occupant_summary(spark, sf):
    s = oc.occupant_summary(fx.points(spark, sf).withColumn("probability", F.col("intensity") / 255), KEYS)
    return s.select(*KEYS, "n", "n_human", *_r("mean_probability", "percent"), "has_human")


_PARTS = {"head": "z >= z85", "torso": "z >= z0 + 0.3::DOUBLE*(z1 - z0) AND z <= z0 + 0.7::DOUBLE*(z1 - z0)"}


@query(
    "h AS (SELECT * FROM pts WHERE semantic_class = 3), q AS (SELECT device_no, scan_idx, quantile_cont(z, 0.85) AS z85, min(z) AS z0, max(z) AS z1 FROM h GROUP BY ALL)\nSELECT device_no, scan_idx, "
    + ", ".join(f"round(avg({a}) FILTER (WHERE {test}), 6) AS {n}_{a}" for n, test in _PARTS.items() for a in "xyz") + ", " + ", ".join(f"round(max({a}) - min({a}), 6) AS size_{a}" for a in "xyz")
    + ", CASE WHEN avg(x) < 2 THEN 'front' ELSE 'back' END AS seat FROM h JOIN q USING (device_no, scan_idx) GROUP BY ALL"
)
def a26_poses(spark, sf):
    return oc.poses(fx.points(spark, sf).where("semantic_class = 3"), KEYS).select(*KEYS, *_r(*(f"{n}_{a}" for n in ("head", "torso", "size") for a in "xyz")), "seat")


def _axis_sql() -> str:
    """``axis``: the first axis of each cloud of ``v``, from its covariances by the closed form."""
    six = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    rows = {"r": ("(cxx - l)", "cxy", "cxz"), "s": ("cxy", "(cyy - l)", "cyz"), "t": ("cxz", "cyz", "(czz - l)")}
    cross = lambda u, v: (f"{u[1]}*{v[2]} - {u[2]}*{v[1]}", f"{u[2]}*{v[0]} - {u[0]}*{v[2]}", f"{u[0]}*{v[1]} - {u[1]}*{v[0]}")
    sides = " UNION ALL ".join(f"SELECT device_no, scan_idx, l, q, {x} AS x, {y} AS y, {z} AS z FROM m3" for a, b in ("rs", "rt", "st") for x, y, z in [cross(rows[a], rows[b])])
    det = "((cxx - q)*((cyy - q)*(czz - q) - cyz*cyz) - cxy*(cxy*(czz - q) - cyz*cxz) + cxz*(cxy*cyz - (cyy - q)*cxz))"
    return f"""m1 AS (SELECT device_no, scan_idx, {", ".join(f"covar_samp({t[0]}, {t[1]}) AS c{t}" for t in six)} FROM v GROUP BY ALL HAVING count(*) >= 3),
m2 AS (SELECT *, sqrt(((cxx - q)*(cxx - q) + (cyy - q)*(cyy - q) + (czz - q)*(czz - q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz))/6) AS p FROM (SELECT *, (cxx + cyy + czz)/3 AS q FROM m1)),
m3 AS (SELECT *, q + 2*p*cos(acos(greatest(least({det}/(p*p*p)/2, 1::DOUBLE), -1::DOUBLE))/3) AS l FROM m2),
side AS ({sides}),
axis AS (SELECT device_no, scan_idx, any_value(l/(3*q)) AS explained, arg_max(x/sqrt(x*x + y*y + z*z)*sign(z), x*x + y*y + z*z) AS ax, arg_max(y/sqrt(x*x + y*y + z*z)*sign(z), x*x + y*y + z*z) AS ay, arg_max(abs(z)/sqrt(x*x + y*y + z*z), x*x + y*y + z*z) AS az FROM side GROUP BY ALL)"""


@query(f"v AS (SELECT * FROM pts WHERE semantic_class BETWEEN 1 AND 4),\n{_axis_sql()}\nSELECT device_no, scan_idx, round(ax, 5) AS ax, round(ay, 5) AS ay, round(az, 5) AS az, round(explained, 5) AS explained FROM axis")
def a27_principal_direction(spark, sf):
    return oc.principal_direction(fx.points(spark, sf).where("semantic_class between 1 and 4"), KEYS).select(*KEYS, *_r("ax", "ay", "az", "explained", places=5))


@query(f"""up AS (SELECT * FROM pts WHERE semantic_class = 3),
{_dbscan_sql("up")},
people AS (SELECT device_no, scan_idx, count(*) AS people FROM (SELECT device_no, scan_idx, cluster_id FROM num WHERE cluster_id >= 0 GROUP BY ALL HAVING count(*) > 20) GROUP BY ALL)
SELECT device_no, scan_idx, n, CASE WHEN n < 10 THEN 0 ELSE coalesce(people, 0) END AS people FROM (SELECT device_no, scan_idx, count(*) AS n FROM up GROUP BY ALL) LEFT JOIN people USING (device_no, scan_idx)""")
def m12_human_count(spark, sf):
    return oc.human_count(fx.points(spark, sf).where("semantic_class = 3"), KEYS, eps=0.6)


def _candidates(spark, sf):
    d = fx.detections(spark, sf)
    return d.select("sequence_no", F.col("det_seq").alias("car_id"), F.col("det_id").alias("cand_id"), "frame_id", (F.col("frame_id") % 3 * 0.4).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), "confidence", "n_points")


@query("""c AS (SELECT sequence_no, det_seq AS car_id, frame_id, CASE WHEN frame_id % 3 = 2 THEN 1 ELSE 0 END AS occupant, confidence, n_points FROM det)
SELECT sequence_no, car_id, occupant, max(confidence) AS confidence, CAST(sum(n_points) AS BIGINT) AS n_points, min(frame_id) AS first_frame, count(*) AS candidates FROM c GROUP BY ALL""")
def m13_merged_occupants(spark, sf):
    """Places 0, 0.4 and 0.8 m in turn: the second joins the first (0.4 < 0.5), the third is someone else."""
    return oc.merged_occupants(_candidates(spark, sf), ["sequence_no", "car_id"])


@query("SELECT sequence_no, frame_id, count(DISTINCT det_seq) AS cars, count(*) AS occupants, CAST(sum(n_points) AS BIGINT) AS points, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence, count(*)/count(DISTINCT det_seq) AS per_car FROM det GROUP BY ALL")
def a28_occupancy_progress(spark, sf):
    p = oc.occupancy_progress(_candidates(spark, sf), ["sequence_no"])
    return p.select("sequence_no", "frame_id", "cars", "occupants", "points", *_r("mean_confidence"), "max_confidence", "per_car")


@query("SELECT det_id AS cand_id, CAST(row_number() OVER o AS INT) AS observation, max(confidence) OVER o AS best FROM det WINDOW o AS (PARTITION BY sequence_no, det_seq ORDER BY frame_id, det_id)")
def w6_confidence_history(spark, sf):
    return oc.confidence_history(_candidates(spark, sf), ["sequence_no", "car_id"]).select("cand_id", "observation", "best")


@query("b AS (SELECT device_no, scan_idx, count(*) AS n, avg(x) AS mx FROM pts GROUP BY ALL)\nSELECT device_no, scan_idx, n, round(mx, 6) AS mx, round(avg(n) OVER (PARTITION BY device_no), 6) AS mean_n FROM b")
def a33_build_up(spark, sf):
    return oc.build_up(fx.points(spark, sf), ["device_no"], "scan_idx").select("device_no", "scan_idx", "n", *_r("mx", "mean_n"))


@query("SELECT det_id, 1::DOUBLE AS r, round(1 - confidence, 6) AS g FROM det")
def p18_confidence_colour(spark, sf):
    c = fx.detections(spark, sf).select("det_id", ge.confidence_colour(F.col("confidence")).alias("c"))
    return c.select("det_id", "c.r", F.round("c.g", 6).alias("g"))
