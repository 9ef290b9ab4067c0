"""Queries over point clouds: filters, geometry, statistics, neighbours and the scene pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.operators import filters as fl
from scanweave.operators import geometry as ge
from scanweave.operators import neighbors as nb
from scanweave.operators import scene as sc
from scanweave.operators import select as se
from scanweave.operators import stats as st
from scanweave.operators.order import exact_quantiles
from scanweave.schema import Params

from . import fixtures as fx
from .fixtures import KEYS, oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}
P = Params(eps=0.6, min_samples=10)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return add


def _r(*columns: str, places: int = 6) -> list:
    return [F.round(c, places).alias(c) for c in columns]


def _pts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.points(spark, sf)


BOUNDS_SQL = "min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max"
KSQL = "device_no, scan_idx"


@query(f"""d AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM pts), t AS (SELECT {KSQL}, quantile_cont(d, 0.95) AS q FROM d GROUP BY {KSQL})
SELECT {KSQL}, count(*) AS n, {BOUNDS_SQL} FROM d JOIN t USING ({KSQL}) WHERE d < q GROUP BY {KSQL}""")
def f1_range_outliers(spark, sf):
    return fl.range_outliers(_pts(spark, sf), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"), *st.bounds_of())


@query(f"""d AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM pts), t AS (SELECT {KSQL}, quantile_cont(d, 0.95) AS q FROM d GROUP BY {KSQL})
SELECT {KSQL}, round(max(q), 6) AS threshold, count(*) FILTER (WHERE d < q) AS kept, count(*) FILTER (WHERE d >= q) AS removed FROM d JOIN t USING ({KSQL}) GROUP BY {KSQL}""")
def f1_report(spark, sf):
    return fl.range_report(_pts(spark, sf), KEYS).select(*KEYS, *_r("threshold"), "kept", "removed")


@query(f"""m AS (SELECT {KSQL}, min(z) AS zm FROM pts GROUP BY {KSQL})
SELECT {KSQL}, count(*) AS n, round(avg(z), 6) AS z_mean FROM pts JOIN m USING ({KSQL}) WHERE z >= zm + 0.4::DOUBLE AND z <= zm + 1.8::DOUBLE GROUP BY {KSQL}""")
def f2_height_band(spark, sf):
    return fl.height_band(_pts(spark, sf), KEYS, 0.4, 1.8).groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("z_mean"))


@query("SELECT point_id, x, y, z FROM pts WHERE x BETWEEN -2 AND 2 AND y BETWEEN -1 AND 1 AND z BETWEEN 0 AND 2")
def f3_box_filter(spark, sf):
    return fl.box_filter(_pts(spark, sf), {"x": (-2, 2), "y": (-1, 1), "z": (0, 2)}).select("point_id", "x", "y", "z")


@query(f"SELECT {KSQL}, count(*) FILTER (WHERE x BETWEEN -2 AND 2 AND y BETWEEN -1 AND 1 AND z BETWEEN 0 AND 2) AS inside, count(*) AS total FROM pts GROUP BY {KSQL}")
def f4_box_count(spark, sf):
    return fl.box_count(_pts(spark, sf), KEYS, {"x": (-2, 2), "y": (-1, 1), "z": (0, 2)})


@query(f"""q AS (SELECT {KSQL}, count(*) AS n, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR z IS NULL OR NOT isfinite(x) OR NOT isfinite(y) OR NOT isfinite(z)) AS n_bad FROM pts GROUP BY {KSQL})
SELECT {KSQL}, n, n_bad, n >= 100 AND n_bad = 0 AS ok, concat_ws('; ', CASE WHEN n < 100 THEN 'too few points' END, CASE WHEN n_bad > 0 THEN 'values that are not finite' END) AS reasons FROM q""")
def f5_quality_gate(spark, sf):
    return fl.quality_gate(_pts(spark, sf), KEYS)


@query("SELECT point_id FROM pts WHERE NOT (abs(x) <= 0.1::DOUBLE AND abs(y) <= 0.1::DOUBLE AND abs(z) <= 0.1::DOUBLE) AND abs(x) < 200 AND abs(y) < 200 AND abs(z) < 50")
def f6_artefact_cut(spark, sf):
    return fl.artefact_cut(_pts(spark, sf)).select("point_id")


@query("SELECT p.point_id, p.device_no, p.scan_idx FROM pts p JOIN (SELECT device_no, scan_idx, avg(x) AS cx, avg(y) AS cy, min(z) AS cz FROM pts WHERE semantic_class BETWEEN 1 AND 4 GROUP BY ALL) c USING (device_no, scan_idx) WHERE x - cx BETWEEN -2.5::DOUBLE AND 0.5::DOUBLE AND y - cy BETWEEN -1 AND 1 AND z - cz BETWEEN 0.5::DOUBLE AND 2")
def f11_car_interior(spark, sf):
    p = _pts(spark, sf)
    c = p.where("semantic_class between 1 and 4").groupBy(*KEYS).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("z").alias("cz"))
    return fl.car_interior(p, c, KEYS).select("point_id", *KEYS)


@query("""b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts)
SELECT box_id, concat_ws(',', CASE WHEN x_min >= x_max THEN 'x inverted' END, CASE WHEN y_min >= y_max THEN 'y inverted' END, CASE WHEN z_min >= z_max THEN 'z inverted' END) AS errors,
concat_ws(',', CASE WHEN x_max < lx OR x_min > hx THEN 'x apart' END, CASE WHEN y_max < ly OR y_min > hy THEN 'y apart' END, CASE WHEN z_max < lz OR z_min > hz THEN 'z apart' END) AS warnings FROM box, b""")
def f13_box_problems(spark, sf):
    b = _pts(spark, sf).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    return fl.box_problems(spark.sql(fx.BOXES), b).select("box_id", "errors", "warnings")


@query(f"SELECT {KSQL}, count(*) FILTER (WHERE semantic_class = 1) AS n_is_exterior, count(*) FILTER (WHERE semantic_class = 3) AS n_is_human, count(*) FILTER (WHERE semantic_class IN (3, 5)) AS n_is_other, count(*) FILTER (WHERE semantic_class IN (1, 2)) AS n_is_vehicle, count(*) AS n FROM pts GROUP BY {KSQL}")
def f15_semantic_split(spark, sf):
    return st.stage_counts(fl.semantic_split(_pts(spark, sf), legacy_other=True), KEYS, ["is_exterior", "is_human", "is_other", "is_vehicle"])


@query("""c AS (SELECT device_no, scan_idx, count(*) FILTER (WHERE x BETWEEN -2 AND 2) AS inside, count(*) AS total FROM pts GROUP BY ALL)
SELECT device_no, scan_idx, inside, total, coalesce(abs(inside - lag(inside) OVER (PARTITION BY device_no ORDER BY scan_idx)) > 0.001::DOUBLE * total, true) AS changed FROM c""")
def f16_count_changes(spark, sf):
    c = _pts(spark, sf).groupBy(*KEYS).agg(F.count_if(F.col("x").between(-2, 2)).alias("inside"), F.count("*").alias("total"))
    return fl.count_changes(c, ["device_no"], "scan_idx")


@query("""s AS (SELECT point_id, transform_id, cx, cy, rotation_deg, cx + (x - cx)*scale AS x, cy + (y - cy)*scale AS y, cz + (z - cz)*scale AS z FROM pts, tra)
SELECT point_id, transform_id, round(cx + (x-cx)*cos(radians(rotation_deg)) - (y-cy)*sin(radians(rotation_deg)), 6) AS x, round(cy + (x-cx)*sin(radians(rotation_deg)) + (y-cy)*cos(radians(rotation_deg)), 6) AS y, round(z, 6) AS z FROM s""")
def p3_transformed(spark, sf):
    return ge.transformed(_pts(spark, sf), spark.sql(fx.TRANSFORMS)).select("point_id", "transform_id", *_r("x", "y", "z"))


@query("SELECT point_id, round(x + 2, 6) AS x, round(y - 3, 6) AS y, round(z + 1, 6) AS z FROM pts")
def p4_moved(spark, sf):
    return ge.moved(_pts(spark, sf), (1, 4, 0), (3, 1, 1)).select("point_id", *_r("x", "y", "z"))


@query(f"""b AS (SELECT {KSQL}, {BOUNDS_SQL} FROM pts GROUP BY {KSQL})
SELECT {KSQL}, round((x_min + x_max)/2, 6) AS cx, round((y_min + y_max)/2, 6) AS cy, round((z_min + z_max)/2, 6) AS cz, round(least(greatest(least(x_max - x_min, y_max - y_min), 0.1::DOUBLE), 3::DOUBLE), 6) AS scale,
round(x_min + 0.3::DOUBLE*(x_max - x_min), 6) AS seat_x, round(z_max - 0.3::DOUBLE, 6) AS roof_z, round(z_min + 0.1::DOUBLE, 6) AS floor_z, round(least(greatest(0.8::DOUBLE*(z_max - z_min)/1.3::DOUBLE, 0.5::DOUBLE), 2::DOUBLE), 6) AS fit FROM b""")
def p5_p16_p17_placement(spark, sf):
    b = ge.fit_scale(ge.placements(ge.transform_of_box(st.bounds(_pts(spark, sf), KEYS))))
    return b.select(*KEYS, *_r("cx", "cy", "cz", "scale", "seat_x", "roof_z", "floor_z", "fit"))


@query(f"""m AS (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY {KSQL})
SELECT {KSQL}, CAST(floor((x - lx)/0.5::DOUBLE) AS BIGINT) AS gx, CAST(floor((y - ly)/0.5::DOUBLE) AS BIGINT) AS gy, CAST(floor((z - lz)/0.5::DOUBLE) AS BIGINT) AS gz, count(*) AS n FROM pts JOIN m USING ({KSQL}) GROUP BY ALL""")
def p10_a9_occupancy(spark, sf):
    return st.occupancy(_pts(spark, sf), KEYS, 0.5)


@query("""c AS (SELECT *, x BETWEEN -2 AND 2 AND y BETWEEN -1 AND 1 AND z BETWEEN 0 AND 2 AS hit FROM pts)
SELECT point_id, CASE WHEN hit THEN 0 ELSE 128 END AS sr, CASE WHEN hit THEN 255 ELSE 128 END AS sg, CASE WHEN hit THEN 0 ELSE 128 END AS sb, coalesce(CAST(intensity AS DOUBLE), z) AS scalar FROM c""")
def p11_p12_colours(spark, sf):
    p = ge.coloured(_pts(spark, sf)).withColumn("c", ge.selection_colour(fl.in_box({"x": (-2, 2), "y": (-1, 1), "z": (0, 2)})))
    return p.select("point_id", *(F.col(f"c.{k}").alias(f"s{k}") for k in "rgb"), "scalar")


@query("SELECT point_id, CASE WHEN r IS NULL THEN z END AS scalar, CASE WHEN r IS NOT NULL THEN least(r, 255) END AS red, CASE WHEN r IS NOT NULL THEN least(g, 255) END AS green, CASE WHEN r IS NOT NULL THEN least(b, 255) END AS blue FROM pts")
def p12_rgb(spark, sf):
    return ge.coloured(_pts(spark, sf), "rgb").select("point_id", "scalar", "red", "green", "blue")


@query(f"""s AS (SELECT {KSQL}, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(z) AS mz, stddev_pop(z) AS sz, min(intensity) AS i0, max(intensity) AS i1 FROM pts GROUP BY {KSQL}),
f AS (SELECT *, (intensity - i0)/(i1 - i0 + 1e-8::DOUBLE) AS grey FROM pts JOIN s USING ({KSQL}))
SELECT point_id, round((x - mx)/(sx + 1e-8::DOUBLE), 5) AS fx, round((y - my)/(sy + 1e-8::DOUBLE), 5) AS fy, round((z - mz)/(sz + 1e-8::DOUBLE), 5) AS fz,
  round(CASE WHEN r IS NULL THEN grey ELSE r/255::DOUBLE END, 5) AS fr, round(CASE WHEN r IS NULL THEN grey ELSE g/255::DOUBLE END, 5) AS fg, round(CASE WHEN r IS NULL THEN grey ELSE b/255::DOUBLE END, 5) AS fb FROM f""")
def p14_features(spark, sf):
    return ge.scaled_features(_pts(spark, sf), KEYS).select("point_id", *_r("fx", "fy", "fz", "fr", "fg", "fb", places=5))


@query("""t AS (SELECT point_id, CASE WHEN point_id % 7 = 0 THEN NULL ELSE x END AS cx, y AS cy, z AS cz, CAST(intensity % 5 - 1 AS DOUBLE) AS scale, CASE WHEN point_id % 11 = 0 THEN NULL ELSE x END AS rotation_deg FROM pts)
SELECT point_id, concat_ws(',', CASE WHEN cx IS NULL THEN 'centre' END, CASE WHEN scale <= 0 THEN 'scale' END, CASE WHEN rotation_deg IS NULL THEN 'rotation' END) AS errors FROM t""")
def f14_transform_problems(spark, sf):
    """Each point as the centre of a transform."""
    p = _pts(spark, sf)
    t = p.select("point_id", F.expr("if(point_id % 7 = 0, null, x)").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), (F.col("intensity") % 5 - 1).cast("double").alias("scale"), F.expr("if(point_id % 11 = 0, null, x)").alias("rotation_deg"))
    return fl.transform_problems(t).select("point_id", "errors")


@query("SELECT point_id, round(CASE WHEN x*40 < 0 THEN x*40 + 360*ceil(-x*40/360) ELSE x*40 - 360*floor(x*40/360) END, 6) AS angle, round(least(greatest(y, -1::DOUBLE), 1.5::DOUBLE), 6) AS held FROM pts")
def p6_clamped(spark, sf):
    return _pts(spark, sf).select("point_id", F.round(ge.normal_rotation(F.col("x") * 40), 6).alias("angle"), F.round(ge.clamp(F.col("y"), -1, 1.5), 6).alias("held"))


@query(f"SELECT {KSQL}, {BOUNDS_SQL} FROM pts GROUP BY {KSQL}")
def a1_bounds(spark, sf):
    return st.bounds(_pts(spark, sf), KEYS)


@query(f"""t AS (SELECT {KSQL}, count(*) AS total FROM pts GROUP BY {KSQL})
SELECT {KSQL}, semantic_class, count(*) AS n, round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y, round(max(z) - min(z), 6) AS extent_z, round(100::DOUBLE*count(*)/max(total), 6) AS percent, {BOUNDS_SQL} FROM pts JOIN t USING ({KSQL}) GROUP BY {KSQL}, semantic_class""")
def a3_class_statistics(spark, sf):
    return st.class_statistics(_pts(spark, sf), KEYS, "semantic_class").select(*KEYS, "semantic_class", "n", *_r("extent_x", "extent_y", "extent_z", "percent"), *(f"{a}_{n}" for a in "xyz" for n in ("min", "max")))


@query(f"""v AS (SELECT *, x_min < x_max AND y_min < y_max AND z_min < z_max AS valid FROM box),
h AS (SELECT {KSQL}, box_id, x, y, z, x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max AND z BETWEEN z_min AND z_max AS hit, (x_max-x_min)*(y_max-y_min)*(z_max-z_min) AS volume FROM pts, v WHERE valid)
SELECT {KSQL}, box_id, count(*) AS total, count(*) FILTER (WHERE hit) AS selected, round(100::DOUBLE*count(*) FILTER (WHERE hit)/count(*), 6) AS percent, round(count(*) FILTER (WHERE hit)/max(volume), 6) AS density,
{", ".join(f"round(avg({a}) FILTER (WHERE hit), 6) AS mean_{a}, round(stddev_pop({a}) FILTER (WHERE hit), 6) AS sigma_{a}, min({a}) FILTER (WHERE hit) AS {a}_min, max({a}) FILTER (WHERE hit) AS {a}_max" for a in "xyz")}, NULL::VARCHAR AS error FROM h GROUP BY {KSQL}, box_id
UNION ALL BY NAME SELECT box_id, 'invalid bounds' AS error FROM v WHERE NOT valid""")
def a4_selection_statistics(spark, sf):
    return st.selection_statistics(_pts(spark, sf), spark.sql(fx.BOXES), KEYS).select(*KEYS, "box_id", "total", "selected", *_r("percent", "density", *(f"{n}_{a}" for a in "xyz" for n in ("mean", "sigma"))), *(f"{a}_{n}" for a in "xyz" for n in ("min", "max")), "error")


@query(f"SELECT {KSQL}, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, {BOUNDS_SQL}, round(count(*)/greatest((max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)), 0.001::DOUBLE), 6) AS density FROM pts GROUP BY {KSQL}")
def a5_model_statistics(spark, sf):
    return st.model_statistics(_pts(spark, sf), KEYS).select(*KEYS, "n", *_r("mean_x", "mean_y", "mean_z"), *(f"{a}_{n}" for a in "xyz" for n in ("min", "max")), *_r("density"))


_CUBES = [f"{kind}_{a}_{n}" for kind in ("cube", "inner") for a in "xyz" for n in ("min", "max")]
_HALF = {"x": 2, "y": 2, "z": 1}


@query("SELECT " + KSQL + ", " + ", ".join(f"round(avg({a}) - {h}, 6) AS cube_{a}_min, round(avg({a}) + {h}, 6) AS cube_{a}_max, round(min({a}) + 0.1::DOUBLE*(max({a})-min({a})), 6) AS inner_{a}_min, round(max({a}) - 0.1::DOUBLE*(max({a})-min({a})), 6) AS inner_{a}_max" for a, h in _HALF.items()) + " FROM pts GROUP BY " + KSQL)
def a6_default_cubes(spark, sf):
    return st.default_cubes(_pts(spark, sf), KEYS).select(*KEYS, *_r(*_CUBES))


@query(f"SELECT {KSQL}, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, round(median(x), 6) AS median_x, round(median(y), 6) AS median_y, round(median(z), 6) AS median_z FROM pts GROUP BY {KSQL}")
def a7_centres(spark, sf):
    return st.centres(_pts(spark, sf), KEYS).select(*KEYS, *_r("mean_x", "mean_y", "mean_z", "median_x", "median_y", "median_z"))


@query(f"""m AS (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY {KSQL}),
v AS (SELECT {KSQL}, floor((x - (lx - 0.25::DOUBLE))/0.5::DOUBLE) AS gx, floor((y - (ly - 0.25::DOUBLE))/0.5::DOUBLE) AS gy, floor((z - (lz - 0.25::DOUBLE))/0.5::DOUBLE) AS gz, point_id, x, y, z FROM pts JOIN m USING ({KSQL}))
SELECT {KSQL}, min(point_id) AS point_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM v GROUP BY {KSQL}, gx, gy, gz""")
def a10_down_sampled(spark, sf):
    return st.down_sampled(_pts(spark, sf), KEYS, 0.5).select(*KEYS, "point_id", *_r("x", "y", "z"), "n")


@query("SELECT device_no, min(ring) AS ring_min, max(ring) AS ring_max, string_agg(DISTINCT ring, ',' ORDER BY ring) AS rings FROM pts GROUP BY device_no")
def a30_rings(spark, sf):
    return st.ring_statistics(_pts(spark, sf), ["device_no"])


@query("SELECT device_no, CAST(CASE WHEN z < 0 THEN 0 WHEN z >= 8 THEN 17 ELSE floor(z/0.5::DOUBLE) + 1 END AS BIGINT) AS bin, count(*) AS n FROM pts GROUP BY ALL")
def a29_histogram(spark, sf):
    return st.histogram(_pts(spark, sf), ["device_no"], "z", 0, 8, 16)


@query(f"""a AS (SELECT {KSQL}, semantic_class AS label, count(*) AS n FROM pts GROUP BY ALL), b AS (SELECT {KSQL}, least(semantic_class, 2) AS label, count(*) AS n FROM pts GROUP BY ALL)
SELECT {KSQL}, label, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM a FULL JOIN b USING ({KSQL}, label)""")
def j11_class_comparison(spark, sf):
    p = _pts(spark, sf)
    return st.class_comparison(p.withColumn("label", F.col("semantic_class")), p.withColumn("label", F.least("semantic_class", F.lit(2))), KEYS)


PAIRS_SQL = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query(f"SELECT a.device_no, a.scan_idx, a.point_id, count(*) AS neighbours FROM pts a JOIN pts b USING ({KSQL}) WHERE {PAIRS_SQL} <= 0.3::DOUBLE*0.3::DOUBLE GROUP BY ALL")
def j3_a8_local_density(spark, sf):
    return nb.local_density(_pts(spark, sf), KEYS, 0.3)


@query(f"""q AS (SELECT * FROM pts WHERE point_id % 50 = 0),
r AS (SELECT a.device_no, a.scan_idx, a.point_id AS a, b.point_id AS b, {PAIRS_SQL} AS d2 FROM q a JOIN pts b USING ({KSQL}))
SELECT * FROM (SELECT device_no, scan_idx, a, b, round(d2, 9) AS d2, CAST(row_number() OVER (PARTITION BY device_no, scan_idx, a ORDER BY d2, b) AS INT) AS rank FROM r) WHERE rank <= 5""")
def j4_nearest_of_sampled_queries(spark, sf):
    """The query set is stated: points whose id is divisible by 50; it is searched in all points."""
    p = _pts(spark, sf)
    return nb.k_nearest(p.where("point_id % 50 = 0"), p, KEYS, 5, whole=nb.WHOLE).select(*KEYS, "a", "b", *_r("d2", places=9), "rank")


@query(f"""e AS (SELECT * FROM pts WHERE point_id % 4 < 2), n AS (SELECT * FROM pts WHERE point_id % 4 >= 2)
SELECT point_id FROM e UNION ALL SELECT point_id FROM n WHERE point_id NOT IN (SELECT b.point_id FROM e a JOIN n b USING ({KSQL}) WHERE {PAIRS_SQL} <= 0.1::DOUBLE*0.1::DOUBLE)""")
def j5_merge_new(spark, sf):
    p = _pts(spark, sf)
    return nb.merge_new(p.where("point_id % 4 < 2"), p.where("point_id % 4 >= 2"), KEYS, 0.1).select("point_id")


@query("SELECT point_id, box_id FROM pts, box WHERE x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max AND z BETWEEN z_min AND z_max")
def j7_points_in_boxes(spark, sf):
    return nb.in_boxes(_pts(spark, sf), spark.sql(fx.BOXES), KEYS).select("point_id", "box_id")


@query(f"""r AS (SELECT device_no, scan_idx, a.point_id AS a, {PAIRS_SQL} AS d2, row_number() OVER (PARTITION BY device_no, scan_idx, a.point_id ORDER BY {PAIRS_SQL}, b.point_id) AS k FROM pts a JOIN pts b USING ({KSQL})),
m AS (SELECT device_no, scan_idx, a, avg(sqrt(d2)) AS md FROM r WHERE k BETWEEN 2 AND 9 GROUP BY ALL),
l AS (SELECT device_no, scan_idx, avg(md) + 2*stddev_pop(md) AS lim FROM m GROUP BY ALL)
SELECT a AS point_id, round(md, 6) AS mean_distance FROM m JOIN l USING ({KSQL}) WHERE md <= lim""")
def m5_statistical_outliers(spark, sf):
    return nb.statistical_outliers(_pts(spark, sf), KEYS, k=8).select("point_id", F.round("md", 6).alias("mean_distance"))


@query("""m AS (SELECT device_no, scan_idx, semantic_class, median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n FROM pts GROUP BY ALL),
d AS (SELECT point_id, device_no, scan_idx, semantic_class, n, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS d FROM pts JOIN m USING (device_no, scan_idx, semantic_class)),
l AS (SELECT device_no, scan_idx, semantic_class, avg(d) + 2*stddev_pop(d) AS lim FROM d GROUP BY ALL)
SELECT point_id FROM d JOIN l USING (device_no, scan_idx, semantic_class) WHERE n < 3 OR d <= lim""")
def m5b_median_outliers(spark, sf):
    return nb.median_outliers(_pts(spark, sf), [*KEYS, "semantic_class"]).select("point_id")


def _plane_sql(base: str) -> str:
    return f"""low AS (SELECT p.device_no, p.scan_idx, point_id, x, y, z FROM {base} p JOIN (SELECT device_no, scan_idx, min(z) AS zm FROM {base} GROUP BY ALL) m USING (device_no, scan_idx) WHERE z <= zm + 0.5::DOUBLE),
good AS (SELECT * FROM low WHERE (device_no, scan_idx) IN (SELECT (device_no, scan_idx) FROM low GROUP BY device_no, scan_idx HAVING count(*) >= 100)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY (point_id % 1000003 * 7919 + 42 * 104729) % 1000033, point_id) - 1 AS r FROM good),
three AS (SELECT device_no, scan_idx, r // 3 AS trial, max(x) FILTER (WHERE r % 3 = 0) AS x0, max(y) FILTER (WHERE r % 3 = 0) AS y0, max(z) FILTER (WHERE r % 3 = 0) AS z0,
  max(x) FILTER (WHERE r % 3 = 1) AS x1, max(y) FILTER (WHERE r % 3 = 1) AS y1, max(z) FILTER (WHERE r % 3 = 1) AS z1,
  max(x) FILTER (WHERE r % 3 = 2) AS x2, max(y) FILTER (WHERE r % 3 = 2) AS y2, max(z) FILTER (WHERE r % 3 = 2) AS z2 FROM ranked WHERE r < 3000 GROUP BY ALL HAVING count(*) = 3),
det3 AS (SELECT *, ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS d FROM three),
pl AS (SELECT *, z0 - a * x0 - b * y0 AS c FROM (SELECT *, ((z1 - z0) * (y2 - y0) - (z2 - z0) * (y1 - y0)) / d AS a, ((x1 - x0) * (z2 - z0) - (x2 - x0) * (z1 - z0)) / d AS b FROM det3 WHERE abs(d) > 1e-9)),
votes AS (SELECT device_no, scan_idx, trial, count(*) AS n FROM good JOIN pl USING (device_no, scan_idx) WHERE abs(z - (a*x + b*y + c)) <= 0.1::DOUBLE GROUP BY ALL),
chosen AS (SELECT device_no, scan_idx, arg_max(trial, n * 10000 - trial) AS trial FROM votes GROUP BY ALL),
sums AS (SELECT device_no, scan_idx, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x*x) - avg(x)*avg(x) AS cxx, avg(x*y) - avg(x)*avg(y) AS cxy, avg(y*y) - avg(y)*avg(y) AS cyy, avg(x*z) - avg(x)*avg(z) AS cxz, avg(y*z) - avg(y)*avg(z) AS cyz
  FROM good JOIN (SELECT * FROM pl JOIN chosen USING (device_no, scan_idx, trial)) USING (device_no, scan_idx) WHERE abs(z - (a*x + b*y + c)) <= 0.1::DOUBLE GROUP BY ALL),
plane AS (SELECT device_no, scan_idx, a, b, mz - a*mx - b*my AS c FROM (SELECT *, (cxz*cyy - cyz*cxy)/(cxx*cyy - cxy*cxy) AS a, (cyz*cxx - cxz*cxy)/(cxx*cyy - cxy*cxy) AS b FROM sums))"""


def _ground_sql(base: str, out: str) -> str:
    """``out``: the points of ``base`` with ``is_ground``."""
    return f"""{_plane_sql(base)},
zs AS (SELECT device_no, scan_idx, min(z) AS zm FROM {base} GROUP BY ALL),
{out} AS (SELECT p.*, coalesce(z - (a*x + b0*y + c) <= 0.15::DOUBLE, z <= zm + 0.2::DOUBLE) AS is_ground FROM {base} p JOIN zs USING (device_no, scan_idx) LEFT JOIN (SELECT device_no, scan_idx, a, b AS b0, c FROM plane) USING (device_no, scan_idx))"""


def _dbscan_sql(up: str, steps: int = 12) -> str:
    """``num``: the points of ``up`` with ``cluster_id``; labels spread over pairs of core points by doubling."""
    spread = "".join(f",\nstep{k} AS (SELECT e.p, min(r.l) AS l FROM e JOIN step{k - 1} r ON e.q = r.p GROUP BY 1)" for k in range(1, steps + 1))
    return f"""pair AS (SELECT a.point_id AS p, b.point_id AS q FROM {up} a JOIN {up} b USING ({KSQL}) WHERE {PAIRS_SQL} <= 0.6::DOUBLE*0.6::DOUBLE),
core AS (SELECT p FROM pair GROUP BY p HAVING count(*) >= 10),
e AS (SELECT p, q FROM pair WHERE p IN (FROM core) AND q IN (FROM core)),
step0 AS (SELECT e.p, min(e.q) AS l FROM e GROUP BY 1){spread},
lab AS (SELECT pair.p, min(s.l) AS l FROM pair JOIN step{steps} s ON pair.q = s.p GROUP BY 1),
num AS (SELECT u.*, CASE WHEN l IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY device_no, scan_idx ORDER BY l NULLS LAST) - 1 END AS cluster_id FROM {up} u LEFT JOIN lab ON u.point_id = lab.p)"""


def _vehicle_sql(ground: str, out: str) -> str:
    """``out``: the points of ``ground`` with ``is_vehicle``."""
    return f"""up AS (SELECT * FROM {ground} WHERE NOT is_ground),
{_dbscan_sql("up")},
best AS (SELECT device_no, scan_idx, arg_max(cluster_id, n * 100000 - cluster_id) AS best FROM (SELECT device_no, scan_idx, cluster_id, count(*) AS n FROM num WHERE cluster_id >= 0 GROUP BY ALL) GROUP BY ALL),
veh AS (SELECT point_id FROM num LEFT JOIN best USING ({KSQL}) JOIN (SELECT device_no, scan_idx, min(z) AS zm FROM up GROUP BY ALL) USING ({KSQL}) WHERE (best IS NULL OR cluster_id = best) AND z <= zm + 3),
{out} AS (SELECT *, point_id IN (FROM veh) AS is_vehicle FROM {ground})"""


@query(f"{_plane_sql('pts')}\nSELECT device_no, scan_idx, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM plane")
def m1_ground_planes(spark, sf):
    return sc.ground_planes(_pts(spark, sf), KEYS, P).select(*KEYS, *_r("a", "b", "c"))


@query(f"{_plane_sql('pts')}\nSELECT point_id, round(z - (a*x + b0*y + c), 6) AS height FROM pts JOIN (SELECT device_no, scan_idx, a, b AS b0, c FROM plane) USING (device_no, scan_idx)")
def p9_height(spark, sf):
    planes = sc.ground_planes(_pts(spark, sf), KEYS, P)
    return ge.above_plane(_pts(spark, sf).drop("b").join(planes, KEYS)).select("point_id", *_r("height"))


@query(f"{_ground_sql('pts', 'grd')}\nSELECT point_id, is_ground FROM grd")
def m2_ground_split(spark, sf):
    return sc.with_ground(_pts(spark, sf), KEYS, P).select("point_id", "is_ground")


@query(f"""up AS (SELECT * FROM pts WHERE z > 0.15::DOUBLE),
{_dbscan_sql("up")}
SELECT point_id, CAST(cluster_id AS INT) AS cluster_id FROM num""")
def m3_dbscan(spark, sf):
    return sc.clusters(_pts(spark, sf).where("z > 0.15D"), KEYS, 0.6, 10).select("point_id", "cluster_id")


@query(f"""{_ground_sql("pts", "grd")},
{_vehicle_sql("grd", "vec")}
SELECT point_id, is_ground, is_vehicle FROM vec""")
def m4_vehicle(spark, sf):
    return sc.with_vehicle(sc.with_ground(_pts(spark, sf), KEYS, P), KEYS, P).select("point_id", "is_ground", "is_vehicle")


def _interior_sql(vehicle: str, hit: str = "hit") -> str:
    """``hit``: the ids of interior points among those of ``vehicle``."""
    return f"""vz AS (SELECT device_no, scan_idx, min(z) AS zm FROM {vehicle} GROUP BY ALL),
band AS (SELECT v.* FROM {vehicle} v JOIN vz USING ({KSQL}) WHERE z >= zm + 0.4::DOUBLE AND z <= zm + 1.8::DOUBLE),
big AS (SELECT device_no, scan_idx FROM band GROUP BY ALL HAVING count(*) >= 10),
near AS (SELECT device_no, scan_idx, a.point_id AS a, {PAIRS_SQL} AS d2, row_number() OVER (PARTITION BY device_no, scan_idx, a.point_id ORDER BY {PAIRS_SQL}, b.point_id) AS k FROM band a JOIN band b USING ({KSQL}) SEMI JOIN big USING ({KSQL})),
apart AS (SELECT device_no, scan_idx, a, avg(sqrt(d2)) AS md FROM near WHERE k <= 8 GROUP BY ALL), lim AS (SELECT device_no, scan_idx, quantile_cont(md, 0.65) AS q FROM apart GROUP BY ALL),
{hit} AS (SELECT a FROM apart JOIN lim USING ({KSQL}) WHERE md > q)"""


@query(f"""v AS (SELECT p.* FROM pts p WHERE semantic_class BETWEEN 1 AND 4),
{_interior_sql("v")}
SELECT point_id, point_id IN (FROM hit) AS is_interior FROM pts""")
def m6a_interior(spark, sf):
    p = _pts(spark, sf).withColumn("is_vehicle", F.col("semantic_class").between(1, 4))
    return sc.with_interior(p, KEYS, P).select("point_id", "is_interior")


@query(f"""o AS (SELECT DISTINCT {KSQL}, CAST(floor((x - lx)/0.5::DOUBLE) AS INT) AS gx, CAST(floor((y - ly)/0.5::DOUBLE) AS INT) AS gy, CAST(floor((z - lz)/0.5::DOUBLE) AS INT) AS gz
  FROM pts JOIN (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY ALL) USING ({KSQL})),
c AS (SELECT {KSQL}, gx, gy, min(gz) AS lo, max(gz) AS hi FROM o GROUP BY ALL), e AS (SELECT {KSQL}, gx, gy, CAST(unnest(range(lo + 1, hi)) AS INT) AS gz FROM c)
SELECT {KSQL}, gx, gy, gz FROM e ANTI JOIN o USING ({KSQL}, gx, gy, gz)
WHERE EXISTS (FROM o WHERE o.device_no = e.device_no AND o.scan_idx = e.scan_idx AND o.gy = e.gy AND o.gz = e.gz AND o.gx < e.gx) AND EXISTS (FROM o WHERE o.device_no = e.device_no AND o.scan_idx = e.scan_idx AND o.gy = e.gy AND o.gz = e.gz AND o.gx > e.gx)
AND EXISTS (FROM o WHERE o.device_no = e.device_no AND o.scan_idx = e.scan_idx AND o.gx = e.gx AND o.gz = e.gz AND o.gy < e.gy) AND EXISTS (FROM o WHERE o.device_no = e.device_no AND o.scan_idx = e.scan_idx AND o.gx = e.gx AND o.gz = e.gz AND o.gy > e.gy)""")
def m6b_enclosed_voxels(spark, sf):
    return sc.enclosed_voxels(st.occupancy(_pts(spark, sf), KEYS, 0.5), KEYS)


_VOID_SQL = f"""o AS (SELECT DISTINCT {KSQL}, CAST(floor((x - lx)/0.3::DOUBLE) AS INT) AS gx, CAST(floor((y - ly)/0.3::DOUBLE) AS INT) AS gy, CAST(floor((z - lz)/0.3::DOUBLE) AS INT) AS gz
  FROM pts JOIN (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY ALL) USING ({KSQL})),
c AS (SELECT {KSQL}, gx, gy, min(gz) AS lo, max(gz) AS hi FROM o GROUP BY ALL), e AS (SELECT {KSQL}, gx, gy, CAST(unnest(range(lo + 1, hi)) AS INT) AS gz FROM c),
void AS (SELECT e.* FROM e JOIN (SELECT {KSQL}, gy, gz, min(gx) AS x0, max(gx) AS x1 FROM o GROUP BY ALL) USING ({KSQL}, gy, gz) JOIN (SELECT {KSQL}, gx, gz, min(gy) AS y0, max(gy) AS y1 FROM o GROUP BY ALL) USING ({KSQL}, gx, gz)
  WHERE x0 < gx AND gx < x1 AND y0 < gy AND gy < y1 AND NOT EXISTS (FROM o WHERE o.device_no = e.device_no AND o.scan_idx = e.scan_idx AND abs(o.gx - e.gx) + abs(o.gy - e.gy) + abs(o.gz - e.gz) <= 0))"""


@query(f"""{_VOID_SQL},
pv AS (SELECT point_id, {KSQL}, CAST(floor((x - lx)/0.3::DOUBLE) AS INT) AS gx, CAST(floor((y - ly)/0.3::DOUBLE) AS INT) AS gy, CAST(floor((z - lz)/0.3::DOUBLE) AS INT) AS gz
  FROM pts JOIN (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts GROUP BY ALL) USING ({KSQL}))
SELECT point_id FROM pv WHERE EXISTS (FROM void v WHERE v.device_no = pv.device_no AND v.scan_idx = pv.scan_idx AND abs(v.gx - pv.gx) + abs(v.gy - pv.gy) + abs(v.gz - pv.gz) <= 1)""")
def m6b_j8_void_interior(spark, sf):
    return sc.with_void_interior(_pts(spark, sf), KEYS, 0.3, 1).where("is_interior").select("point_id")


def _shell_sql(name: str = "o") -> str:
    """``o``: occupied voxels of the boxes; ``far``: enclosed ones, two steps from all of these."""
    at = ", ".join(f"CAST(floor(({a} - l{a})/0.5::DOUBLE) AS BIGINT) AS g{a}" for a in "xyz")
    same = "{0}.device_no = {1}.device_no AND {0}.scan_idx = {1}.scan_idx".format("o", "e")
    side = lambda a, s: f"EXISTS (FROM o WHERE {same} AND " + " AND ".join(f"o.g{b} {s if a == b else '='} e.g{b}" for b in "xyz") + ")"
    return f"""pv AS (SELECT point_id, {KSQL}, {at} FROM shl JOIN (SELECT {KSQL}, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM shl GROUP BY ALL) USING ({KSQL})),
o AS (SELECT DISTINCT {KSQL}, gx, gy, gz FROM pv),
e AS (SELECT {KSQL}, gx, gy, gz FROM (SELECT {KSQL}, unnest(range(min(gx), max(gx) + 1)) AS gx, min(gy) AS y0, max(gy) AS y1, min(gz) AS z0, max(gz) AS z1 FROM o GROUP BY {KSQL}), (SELECT unnest(range(0, 20)) AS gy), (SELECT unnest(range(0, 20)) AS gz)
  WHERE gy <= y1 AND gz <= z1),
far AS (SELECT * FROM e WHERE NOT EXISTS (FROM o WHERE {same} AND abs(o.gx - e.gx) + abs(o.gy - e.gy) + abs(o.gz - e.gz) < 2) AND {" AND ".join(side(a, s) for a in "xyz" for s in "<>")})"""


def _shell_cells(spark, sf):
    return st.occupancy(fx.shell(spark, sf), KEYS, 0.5)


@query(f"{_shell_sql()}\nSELECT * FROM far")
def m6b_void_voxels(spark, sf):
    """The survey's distance of two voxels, in clouds that enclose something."""
    return sc.void_voxels(_shell_cells(spark, sf), KEYS, 2)


_STEP = "abs(a.gx - b.gx) + abs(a.gy - b.gy) + abs(a.gz - b.gz) <= 1"


@query(f"""{_shell_sql()},
thin AS (SELECT a.* FROM far a JOIN far b USING ({KSQL}) WHERE {_STEP} GROUP BY ALL HAVING count(*) = 7)
SELECT DISTINCT {", ".join(f"CAST(b.{c} AS BIGINT) AS {c}" for c in ("device_no", "scan_idx", "gx", "gy", "gz"))} FROM thin a JOIN far b USING ({KSQL}) WHERE {_STEP}""")
def m6b_opened_void(spark, sf):
    """Opening by one step; all that the dilation reaches is of the void itself."""
    return sc.void_voxels(_shell_cells(spark, sf), KEYS, 2, opening=1).select(*KEYS, "gx", "gy", "gz")


@query(f"""{_shell_sql()}
SELECT point_id FROM pv WHERE EXISTS (FROM far v WHERE v.device_no = pv.device_no AND v.scan_idx = pv.scan_idx AND abs(v.gx - pv.gx) + abs(v.gy - pv.gy) + abs(v.gz - pv.gz) <= 2)""")
def m6b_j8_shell_interior(spark, sf):
    return sc.with_void_interior(fx.shell(spark, sf), KEYS, 0.5, 2).where("is_interior").select("point_id")


def _noise_sql() -> str:
    """``u``: six uniform numbers of each point, by the rule of the counter."""
    made = ["r0 AS (SELECT point_id, x, y, z, " + ", ".join(f"point_id % 2147483647 * 48271 + {42 * 69621 + k * 40692 + 1} AS v{k}" for k in range(6)) + " FROM pts)"]
    for j in range(3):
        step = lambda k, j=j: f"(v{k} % 2147483647) * (v{k} % 2147483647) + (v{k} % 2147483647) * 16807 + {(j + 1) * 69621} AS v{k}"
        made.append(f"r{j + 1} AS (SELECT point_id, x, y, z, {', '.join(step(k) for k in range(6))} FROM r{j})")
    return ",\n".join(made) + ",\nu AS (SELECT point_id, x, y, z, " + ", ".join(f"(v{k} % 2147483647 + 0.5::DOUBLE) / 2147483647 AS u{k}" for k in range(6)) + " FROM r3)"


@query(_noise_sql() + "\nSELECT point_id, " + ", ".join(f"round({a} + 0.05::DOUBLE*sqrt(-2*ln(u{2 * k}))*cos(2*pi()*u{2 * k + 1}), 6) AS {a}" for k, a in enumerate("xyz")) + " FROM u")
def p7_jittered(spark, sf):
    return ge.jittered(_pts(spark, sf), 0.05).select("point_id", *_r("x", "y", "z"))


def _one_cloud(spark, sf):
    """All points as one cloud."""
    return _pts(spark, sf).withColumns({"device_no": F.lit(0).cast("long"), "scan_idx": F.lit(0).cast("long")})


_ONE = "one AS (SELECT * REPLACE (0::BIGINT AS device_no, 0::BIGINT AS scan_idx) FROM pts)"


@query(f"{_ONE}, d AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM one)\nSELECT round(quantile_cont(d, 0.95), 6) AS far, round(median(x), 6) AS mx, round(median(y), 6) AS my, round(median(z), 6) AS mz FROM d")
def f1_a7_one_cloud(spark, sf):
    d = _one_cloud(spark, sf).withColumn("d", fl.norm())
    return exact_quantiles(d, KEYS, {"far": ("d", 0.95), "mx": ("x", 0.5), "my": ("y", 0.5), "mz": ("z", 0.5)}).select(*_r("far", "mx", "my", "mz"))


@query(f"{_ONE},\n{_plane_sql('one')}\nSELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM plane")
def m1_one_cloud(spark, sf):
    return sc.ground_planes(_one_cloud(spark, sf), KEYS, P).select(*_r("a", "b", "c"))


@query(f"""{_ONE},
up AS (SELECT * FROM one WHERE z > 0.15::DOUBLE),
{_dbscan_sql("up")}
SELECT point_id, CAST(cluster_id AS INT) AS cluster_id FROM num""")
def m3_one_cloud(spark, sf):
    return sc.clusters(_one_cloud(spark, sf).where("z > 0.15D"), KEYS, 0.6, 10).select("point_id", "cluster_id")


@query(f"""v AS (SELECT * FROM pts WHERE semantic_class BETWEEN 1 AND 4),
b AS (SELECT {KSQL}, min(z) AS zm, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY ALL)
SELECT {KSQL}, x1 - x0 > y1 - y0 AS along_x, count(*) FILTER (WHERE x >= (x0 + x1)/2) AS n_front, count(*) FILTER (WHERE x < (x0 + x1)/2) AS n_rear, count(*) FILTER (WHERE x >= (x0 + x1)/2) > count(*) FILTER (WHERE x < (x0 + x1)/2) AS front_positive FROM v JOIN b USING ({KSQL})
WHERE z >= zm + 0.8::DOUBLE AND z <= zm + 1.4::DOUBLE GROUP BY ALL""")
def a21_orientation(spark, sf):
    return sc.orientation(_pts(spark, sf).where("semantic_class between 1 and 4"), KEYS).select(*KEYS, "along_x", "n_front", "n_rear", "front_positive")


@query(f"""v AS (SELECT * FROM pts WHERE semantic_class BETWEEN 1 AND 4),
b AS (SELECT {KSQL}, min(z) AS zm, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(y) AS ym FROM v GROUP BY ALL),
f AS (SELECT {KSQL}, count(*) FILTER (WHERE x >= (x0 + x1)/2) > count(*) FILTER (WHERE x < (x0 + x1)/2) AS pos FROM v JOIN b USING ({KSQL}) WHERE z >= zm + 0.8::DOUBLE AND z <= zm + 1.4::DOUBLE GROUP BY ALL),
k AS (SELECT point_id, {KSQL}, coalesce(CASE WHEN pos THEN x >= x0 + 0.33::DOUBLE*(x1 - x0) ELSE x <= x1 - 0.33::DOUBLE*(x1 - x0) END AND abs(y - ym) <= 0.35::DOUBLE*(y1 - y0) AND z >= zm + 0.6::DOUBLE AND z <= zm + 1.6::DOUBLE, false) AS ok FROM v JOIN b USING ({KSQL}) LEFT JOIN f USING ({KSQL}))
SELECT point_id FROM k JOIN (SELECT {KSQL}, bool_or(ok) AS front FROM k GROUP BY ALL) USING ({KSQL}) WHERE ok OR NOT front""")
def m11_cockpit(spark, sf):
    p = _pts(spark, sf).withColumn("is_interior", F.col("semantic_class").between(1, 4))
    return sc.with_cockpit(p, KEYS, P).where("is_cockpit").select("point_id")


_FRONT = "count(*) FILTER (WHERE CASE WHEN x1 - x0 > y1 - y0 THEN x >= (x0 + x1)/2 ELSE y >= (y0 + y1)/2 END)"
_REAR = "count(*) FILTER (WHERE CASE WHEN x1 - x0 > y1 - y0 THEN x < (x0 + x1)/2 ELSE y < (y0 + y1)/2 END)"


@query(f"""far AS (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM pts), cut AS (SELECT f.* EXCLUDE (d) FROM far f JOIN (SELECT {KSQL}, quantile_cont(d, 0.95) AS q FROM far GROUP BY {KSQL}) USING ({KSQL}) WHERE d < q),
{_ground_sql("cut", "grd")},
{_vehicle_sql("grd", "vec")},
v AS (SELECT * FROM vec WHERE is_vehicle),
{_interior_sql("v")},
own AS (SELECT * FROM v WHERE point_id IN (FROM hit)),
ob AS (SELECT {KSQL}, min(z) AS zm, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, avg(x) AS xm, avg(y) AS ym FROM own GROUP BY ALL),
fr AS (SELECT {KSQL}, any_value(x1 - x0 > y1 - y0) AS along_x, {_FRONT} > {_REAR} AS pos FROM own JOIN ob USING ({KSQL}) WHERE z >= zm + 0.8::DOUBLE AND z <= zm + 1.4::DOUBLE GROUP BY ALL),
place AS (SELECT point_id, {KSQL}, z, zm, pos, CASE WHEN along_x THEN x ELSE y END AS m, CASE WHEN along_x THEN x0 ELSE y0 END AS m0, CASE WHEN along_x THEN x1 ELSE y1 END AS m1,
  CASE WHEN along_x THEN y ELSE x END AS s, CASE WHEN along_x THEN y0 ELSE x0 END AS s0, CASE WHEN along_x THEN y1 ELSE x1 END AS s1, CASE WHEN along_x THEN ym ELSE xm END AS sm FROM own JOIN ob USING ({KSQL}) LEFT JOIN fr USING ({KSQL})),
k AS (SELECT point_id, {KSQL}, coalesce(CASE WHEN pos THEN m >= m0 + 0.33::DOUBLE*(m1 - m0) ELSE m <= m1 - 0.33::DOUBLE*(m1 - m0) END AND abs(s - sm) <= 0.35::DOUBLE*(s1 - s0) AND z >= zm + 0.6::DOUBLE AND z <= zm + 1.6::DOUBLE AND pos IS NOT NULL, false) AS ok FROM place),
pit AS (SELECT point_id FROM k JOIN (SELECT {KSQL}, bool_or(ok) AS front FROM k GROUP BY ALL) USING ({KSQL}) WHERE ok OR NOT front)
SELECT {KSQL}, count(*) AS n, count(*) FILTER (WHERE is_ground) AS n_is_ground, count(*) FILTER (WHERE is_vehicle) AS n_is_vehicle, count(*) FILTER (WHERE point_id IN (FROM hit)) AS n_is_interior,
  count(*) FILTER (WHERE point_id IN (FROM pit)) AS n_is_cockpit, any_value(along_x) AS along_x, any_value(pos) AS front_positive FROM vec LEFT JOIN fr USING ({KSQL}) GROUP BY {KSQL}""")
def scene_pipeline(spark, sf):
    """M14 over all clouds at once, with the orientation of each vehicle."""
    done = sc.ScenePipeline().run(_pts(spark, sf), KEYS, P)
    counts = st.stage_counts(done, KEYS, ["is_ground", "is_vehicle", "is_interior", "is_cockpit"])
    front = sc.orientation(done.where("is_interior"), KEYS, P).select(*KEYS, "along_x", "front_positive")
    return counts.join(front, KEYS, "left")


@query("SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY point_id) - 1 AS r FROM pts) WHERE r % 3 = 0")
def s11_stride(spark, sf):
    return se.stride(_pts(spark, sf), KEYS, "point_id", 3).select("point_id")


@query("SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY point_id) AS r FROM pts) WHERE r <= 50")
def t4_first_points(spark, sf):
    return se.first_n(_pts(spark, sf), KEYS, ["point_id"], 50).select("point_id")


@query("SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY (point_id % 1000003 * 7919 + 42 * 104729) % 1000033, point_id) AS k FROM pts) WHERE k <= 64")
def t5_random_cap(spark, sf):
    return se.random_cap(_pts(spark, sf), KEYS, "point_id", 64).select("point_id")


@query("""w AS (SELECT point_id, row_number() OVER (PARTITION BY device_no, scan_idx ORDER BY point_id) - 1 AS k, count(*) OVER (PARTITION BY device_no, scan_idx) AS n FROM pts)
SELECT point_id FROM w WHERE n <= 30 OR (k % (n // 30) = 0 AND k // (n // 30) < 30)""")
def t6_uniform_sample(spark, sf):
    return se.uniform_sample(_pts(spark, sf), KEYS, "point_id", 30).select("point_id")


@query("SELECT point_id, 'a' AS source FROM pts WHERE point_id % 2 = 0 UNION ALL SELECT point_id, 'b' FROM pts WHERE point_id % 2 <> 0 OR point_id % 3 = 0")
def u1_concatenated(spark, sf):
    p = _pts(spark, sf).select("point_id")
    return se.concatenated({"a": p.where("point_id % 2 = 0"), "b": p.where("point_id % 2 <> 0 or point_id % 3 = 0")})


@query("SELECT point_id FROM pts WHERE point_id % 2 = 0 AND point_id % 3 <> 0")
def u2_difference(spark, sf):
    p = _pts(spark, sf).select("point_id")
    return se.without(p.where("point_id % 2 = 0"), p.where("point_id % 3 = 0"), ["point_id"])


@query(f"""parts AS (SELECT {KSQL}, ring AS part, count(*) AS n, min(z) AS low FROM pts GROUP BY ALL)
SELECT {KSQL}, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(CAST(floor(low*100) AS BIGINT) AS VARCHAR), ',' ORDER BY part) AS lows FROM parts GROUP BY ALL""")
def u3_combined(spark, sf):
    """Counts of each ring's points added up, and their least heights in a list."""
    parts = _pts(spark, sf).groupBy(*KEYS, F.col("ring").alias("part")).agg(F.count("*").alias("n"), F.floor(F.min("z") * 100).cast("string").alias("lows"))
    return se.combined(parts, KEYS, ["n"], ["lows"]).select(*KEYS, "n", F.array_join("lows", ",").alias("lows"))
