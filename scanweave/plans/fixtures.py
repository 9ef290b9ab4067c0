"""Point clouds and detections derived from the ``events`` table by integer arithmetic, so that both engines see the same rows.

``k`` is the second decimal digit of an event's number, so each cloud has the same mix of ground, one vehicle, and clutter. Every ten thousand events
are ten clouds, five scans of two devices, so more rows are more clouds. Points of device 1 have colours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ["device_no", "scan_idx"]
TRACK_KEYS = ["device_no", "sequence_no"]

_POINTS = """
SELECT i AS point_id, i % 2 AS device_no, (i {div} 10000)*5 + (i {div} 2) % 5 AS scan_idx,
  CASE WHEN k < 4 THEN a*20 - 10 WHEN k < 9 THEN a*CAST(4.5 AS DOUBLE) - CAST(2.25 AS DOUBLE) ELSE a*60 - 30 END AS x,
  CASE WHEN k < 4 THEN b*20 - 10 WHEN k < 9 THEN b*CAST(1.8 AS DOUBLE) - CAST(0.9 AS DOUBLE) ELSE b*60 - 30 END AS y,
  CASE WHEN k < 4 THEN (c - CAST(0.5 AS DOUBLE))*CAST(0.1 AS DOUBLE)
       WHEN k < 9 THEN CAST(0.3 AS DOUBLE) + c*CAST(1.5 AS DOUBLE) ELSE c*8 END AS z,
  CAST(i % 256 AS INT) AS intensity, CAST(i % 16 AS INT) AS ring,
  CAST(CASE WHEN i % 2 = 1 THEN i % 251 END AS INT) AS r, CAST(CASE WHEN i % 2 = 1 THEN i % 301 END AS INT) AS g, CAST(CASE WHEN i % 2 = 1 THEN i % 239 END AS INT) AS b,
  CAST(CASE WHEN k < 4 THEN 0 WHEN k < 9 THEN 1 + i % 4 ELSE 5 END AS INT) AS semantic_class
FROM (SELECT event_id AS i, (event_id {div} 10) % 10 AS k,
    CAST((event_id*7919 + 104729) % 100003 AS DOUBLE) / 100003 AS a,
    CAST((event_id*event_id*31 + event_id*15485863 + 7) % 100019 AS DOUBLE) / 100019 AS b,
    CAST((event_id*event_id*17 + event_id*49979687 + 13) % 100043 AS DOUBLE) / 100043 AS c
  FROM {events}) h
"""
_DETECTIONS = """
SELECT i AS det_id, s % 2 AS device_no, s AS sequence_no, f AS frame_id, CASE WHEN o % 2 = 0 THEN 'cam0' ELSE 'cam1' END AS camera, o AS det_seq,
  CAST(s AS DOUBLE)*1000 + CAST(f AS DOUBLE)/10 + CASE WHEN f >= 20 THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ts,
  CAST(110 + o*300 + f*4 AS DOUBLE) AS x1, CAST(260 + o*50 AS DOUBLE) AS y1, CAST(190 + o*300 + f*4 AS DOUBLE) AS x2, CAST(340 + o*50 AS DOUBLE) AS y2,
  CAST(50 + (i*37) % 50 AS DOUBLE)/100 AS confidence,
  CAST(o*10 AS DOUBLE) + CAST(f AS DOUBLE)/5 AS cx, CAST(o AS DOUBLE) AS cy, CAST(1 AS DOUBLE) AS cz, (i*7) % 40 AS n_points, CAST(2 AS INT) AS class_id
FROM (SELECT event_id AS i, event_id % 6 AS o, (event_id {div} 6) % 40 AS f, event_id {div} 240 AS s FROM {events}) k
"""
#: Each event is a point seen in five scans, every third of them 5.5 cm farther in the last two; scans of one device.
_MOVING = """
SELECT i * 5 + s AS point_id, i % 2 AS device_no, s AS scan_idx, x + CASE WHEN i % 3 = 0 AND s >= 3 THEN CAST(0.055 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x, y, z
FROM (SELECT event_id AS i, CAST((event_id*7919 + 104729) % 100003 AS DOUBLE) / 100003 * 4000 AS x,
    CAST((event_id*event_id*31 + event_id*15485863 + 7) % 100019 AS DOUBLE) / 100019 * 4000 AS y,
    CAST((event_id*event_id*17 + event_id*49979687 + 13) % 100043 AS DOUBLE) / 100043 AS z FROM {events}) p
CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) q
"""
#: Clouds of five hundred points, which cover the walls of a box of nine voxels of half a metre a side; the last fourteen stand in it as one heap.
_SHELL = """
SELECT i AS point_id, device_no, scan_idx, gx*CAST(0.5 AS DOUBLE) + CASE WHEN gx > 0 THEN h ELSE CAST(0 AS DOUBLE) END AS x, gy*CAST(0.5 AS DOUBLE) + CASE WHEN gy > 0 THEN h ELSE CAST(0 AS DOUBLE) END AS y,
  gz*CAST(0.5 AS DOUBLE) + CASE WHEN gz > 0 THEN h ELSE CAST(0 AS DOUBLE) END AS z
FROM (SELECT i, device_no, scan_idx, h, CASE WHEN j >= 486 THEN 4 WHEN f = 0 THEN 0 WHEN f = 1 THEN 8 ELSE u END AS gx,
    CASE WHEN j >= 486 THEN 4 WHEN f = 2 THEN 0 WHEN f = 3 THEN 8 WHEN f < 2 THEN u ELSE v END AS gy, CASE WHEN j >= 486 THEN 2 WHEN f = 4 THEN 0 WHEN f = 5 THEN 8 ELSE v END AS gz
  FROM (SELECT i, device_no, scan_idx, h, j, j % 6 AS f, (j {div} 6) % 9 AS u, (j {div} 54) % 9 AS v
    FROM (SELECT event_id AS i, event_id % 2 AS device_no, event_id {div} 1000 AS scan_idx, (event_id {div} 2) % 500 AS j, CAST((event_id*7919 + 104729) % 100003 AS DOUBLE) / 100003 * CAST(0.4 AS DOUBLE) AS h FROM {events}) a) b) c
"""
_FRAMES = (
    "SELECT device_no, sequence_no, frame_id, ts, CASE frame_id % 4 WHEN 0 THEN 'poor' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'good' ELSE 'excellent' END AS sync_quality "
    "FROM (SELECT DISTINCT device_no, sequence_no, frame_id, ts FROM ({det}) d) f"
)
#: Two devices and two cameras; forward is +x; some points are behind.
CALIBRATION = (
    "SELECT device_no, camera, CAST(1000 AS DOUBLE) AS fx, CAST(1000 AS DOUBLE) AS fy, CAST(960 AS DOUBLE) AS cx0, CAST(600 AS DOUBLE) AS cy0, "
    "CAST(0 AS DOUBLE) AS r11, CAST(-1 AS DOUBLE) AS r12, CAST(0 AS DOUBLE) AS r13, CAST(0 AS DOUBLE) AS r21, CAST(0 AS DOUBLE) AS r22, CAST(-1 AS DOUBLE) AS r23, "
    "CAST(1 AS DOUBLE) AS r31, CAST(0 AS DOUBLE) AS r32, CAST(0 AS DOUBLE) AS r33, shift AS t1, CAST(2 AS DOUBLE) AS t2, CAST(20 AS DOUBLE) AS t3 "
    "FROM (SELECT 0 AS device_no, 'cam0' AS camera, CAST(0 AS DOUBLE) AS shift UNION ALL SELECT 0, 'cam1', CAST(1 AS DOUBLE) UNION ALL SELECT 1, 'cam0', CAST(0 AS DOUBLE) "
    "UNION ALL SELECT 1, 'cam1', CAST(-1 AS DOUBLE)) c"
)
BOXES = (
    "SELECT box_id, CAST(a AS DOUBLE) AS x_min, CAST(b AS DOUBLE) AS x_max, CAST(c AS DOUBLE) AS y_min, CAST(d AS DOUBLE) AS y_max, CAST(e AS DOUBLE) AS z_min, CAST(f AS DOUBLE) AS z_max "
    "FROM (SELECT 'inside' AS box_id, -2 AS a, 2 AS b, -1 AS c, 1 AS d, 0 AS e, 2 AS f UNION ALL SELECT 'apart', 100, 110, -1, 1, 0, 2 UNION ALL SELECT 'inverted', -2, 2, -1, 1, 2, 0 "
    "UNION ALL SELECT 'wide', -8, 8, -8, 8, -1, 8) b"
)
TRANSFORMS = (
    "SELECT transform_id, CAST(1 AS DOUBLE) AS cx, CAST(2 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS cz, CAST(scale AS DOUBLE) AS scale, CAST(deg AS DOUBLE) AS rotation_deg FROM ("
    "SELECT 'same' AS transform_id, 1 AS scale, 0 AS deg UNION ALL SELECT 'quarter', 1, 90 UNION ALL SELECT 'full', 1, 360 UNION ALL SELECT 'back', 1, -30 UNION ALL SELECT 'double', 2, 45) t"
)


def _made(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sql.replace("{div}", "DIV"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_POINTS, spark, sf_dir)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_DETECTIONS, spark, sf_dir)


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_MOVING, spark, sf_dir)


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_SHELL, spark, sf_dir)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_FRAMES.replace("{det}", _DETECTIONS), spark, sf_dir)


def oracle(body: str) -> str:
    """DuckDB SQL over the views ``pts, det, mov, shl, frm, cal, box, tra``; a body that begins with RECURSIVE may refer to itself."""
    body, word = body.strip(), "WITH "
    if body.startswith("RECURSIVE "):
        body, word = body.removeprefix("RECURSIVE "), "WITH RECURSIVE "
    duck = lambda s: s.replace("{div}", "//").replace("{events}", "events").strip()
    views = {"pts": _POINTS, "det": _DETECTIONS, "mov": _MOVING, "shl": _SHELL, "frm": _FRAMES.replace("{det}", _DETECTIONS), "cal": CALIBRATION, "box": BOXES, "tra": TRANSFORMS}
    return word + ",\n".join(f"{n} AS ({duck(s)})" for n, s in views.items()) + ("" if body.lstrip().upper().startswith("SELECT") else ",") + f"\n{body.strip()}"
