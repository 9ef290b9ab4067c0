"""Occupants of vehicles from points that carry a semantic class."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import exact_quantiles
from .scene import clusters
from .tracking import in_order


def occupant_summary(points: DataFrame, keys: list[str], probability: str = "probability") -> DataFrame:
    """People are there if over 50 points are human, of mean probability over 0.3."""
    human = F.col("semantic_class") == 3
    got = points.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(human).alias("n_human"), F.avg(F.when(human, F.col(probability))).alias("mean_probability"))
    found = (F.col("n_human") > 50) & (F.coalesce("mean_probability", F.lit(0.0)) > 0.3)
    return got.withColumns({"percent": 100.0 * F.col("n_human") / F.col("n"), "has_human": found})


def poses(points: DataFrame, keys: list[str], front_limit: float = 2.0) -> DataFrame:
    """Head (mean of the top 15 % by height), torso (mean of 30 to 70 % of the height), front or back seat, and box."""
    q = points.groupBy(*keys).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    own = points.join(q, keys).join(exact_quantiles(points, keys, {"z85": ("z", 0.85)}), keys)
    h = F.col("z1") - F.col("z0")
    head, torso = F.col("z") >= F.col("z85"), (F.col("z") >= F.col("z0") + 0.3 * h) & (F.col("z") <= F.col("z0") + 0.7 * h)
    part = lambda test, name: [F.avg(F.when(test, F.col(a))).alias(f"{name}_{a}") for a in "xyz"]
    got = own.groupBy(*keys).agg(*part(head, "head"), *part(torso, "torso"), *((F.max(a) - F.min(a)).alias(f"size_{a}") for a in "xyz"), F.avg("x").alias("mx"))
    return got.withColumn("seat", F.when(F.col("mx") < front_limit, "front").otherwise("back"))


def principal_direction(points: DataFrame, keys: list[str]) -> DataFrame:
    """First principal axis (upwards, or else forwards), its yaw and pitch, and the share of variance it explains, for three points and more.

    The covariance matrix is six distributed sums. Its eigenvalues have a closed form, by cosines of an angle; the axis is the longest cross product of
    two rows of the matrix less the greatest. Where that value is double, or all points are one, no axis is first and it is null. It is all column
    expressions.
    """
    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_samp(t[0], t[1]).alias(f"c{t}") for t in pairs)).where("n >= 3")
    m = m.withColumn("q", F.expr("(cxx + cyy + czz) / 3"))
    m = m.withColumn("p", F.expr("sqrt(((cxx - q)*(cxx - q) + (cyy - q)*(cyy - q) + (czz - q)*(czz - q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz)) / 6)"))
    det = "((cxx - q)*((cyy - q)*(czz - q) - cyz*cyz) - cxy*(cxy*(czz - q) - cyz*cxz) + cxz*(cxy*cyz - (cyy - q)*cxz))"
    m = m.withColumn("l", F.expr(f"case when p > 0 then q + 2*p*cos(acos(greatest(least({det} / (p*p*p) / 2, 1D), -1D)) / 3) end"))
    rows = {"r": ("(cxx - l)", "cxy", "cxz"), "s": ("cxy", "(cyy - l)", "cyz"), "t": ("cxz", "cyz", "(czz - l)")}
    cross = lambda u, v: [f"{u[1]}*{v[2]} - {u[2]}*{v[1]}", f"{u[2]}*{v[0]} - {u[0]}*{v[2]}", f"{u[0]}*{v[1]} - {u[1]}*{v[0]}"]
    each = [cross(rows[a], rows[b]) for a, b in ("rs", "rt", "st")]
    sides = F.array(*(F.struct((F.expr(" + ".join(f"({c})*({c})" for c in v))).alias("d"), *(F.expr(c).alias(a) for c, a in zip(v, "xyz", strict=True))) for v in each))
    m = m.withColumn("v", F.array_max(sides))
    lead = F.when(F.abs("v.z") > 1e-12 * F.sqrt("v.d"), F.col("v.z")).when(F.abs("v.x") > 1e-12 * F.sqrt("v.d"), F.col("v.x")).otherwise(F.col("v.y"))
    length = F.when(F.col("v.d") > F.pow(F.col("p"), F.lit(4)) * 1e-20, F.sqrt("v.d") * F.when(lead < 0, -1).otherwise(1))
    m = m.withColumns({f"a{a}": F.col(f"v.{a}") / length for a in "xyz"})
    pitch = F.asin(F.greatest(F.least("az", F.lit(1.0)), F.lit(-1.0)))
    return m.select(*keys, "ax", "ay", "az", F.when(F.col("ax").isNotNull(), F.atan2("ay", "ax")).alias("yaw"), F.when(F.col("az").isNotNull(), pitch).alias("pitch"), F.try_divide("l", 3 * F.col("q")).alias("explained"))


def human_count(points: DataFrame, keys: list[str], eps: float = 0.3, min_samples: int = 10, more_than: int = 20) -> DataFrame:
    """Clusters of over 20 points among a cloud's human points; none for clouds of under ten."""
    enough = points.groupBy(*keys).agg(F.count("*").alias("n"))
    found = clusters(points, keys, eps, min_samples).where("cluster_id >= 0").groupBy(*keys, "cluster_id").agg(F.count("*").alias("m")).where(F.col("m") > more_than)
    people = found.groupBy(*keys).agg(F.count("*").alias("people"))
    return enough.join(people, keys, "left").select(*keys, "n", F.when(F.col("n") < 10, 0).otherwise(F.coalesce("people", F.lit(0))).alias("people"))


def merged_occupants(candidates: DataFrame, keys: list[str], distance: float = 0.5) -> DataFrame:
    """Candidates (``cand_id, frame_id, x, y, z, confidence, n_points``) of a car in order; each joins the first occupant nearer than the distance.

    A car's candidates pass through a task in order, as rows; it holds the first place of each occupant, by cells of the distance."""
    own = candidates.select(*keys, "cand_id", "frame_id", "x", "y", "z", "confidence", "n_points")

    def start() -> Callable[[tuple], tuple]:
        cells: dict[tuple[int, int, int], list[tuple]] = {}
        count = 0

        def take(r: tuple) -> tuple:
            nonlocal count
            cand, x, y, z = r[:4]
            i, j, k = (math.floor(v / distance) for v in (x, y, z))
            near = [n for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for n, q in cells.get((i + a, j + b, k + c), ()) if math.dist(q, (x, y, z)) < distance]
            if near:
                return cand, min(near)
            cells.setdefault((i, j, k), []).append((count, (x, y, z)))
            count += 1
            return cand, count - 1

        return take

    who = in_order(own, keys, ["frame_id", "cand_id"], ["cand_id", "x", "y", "z", "frame_id"], "cand_id BIGINT, occupant BIGINT", start)
    both = own.join(who, [*keys, "cand_id"])
    return both.groupBy(*keys, "occupant").agg(F.max("confidence").alias("confidence"), F.sum("n_points").alias("n_points"), F.min("frame_id").alias("first_frame"), F.count("*").alias("candidates"))


def occupancy_progress(candidates: DataFrame, keys: list[str], car: str = "car_id") -> DataFrame:
    """By frame: cars, occupants, points, mean and best confidence, occupants per car."""
    got = candidates.groupBy(*keys, "frame_id").agg(
        F.countDistinct(car).alias("cars"), F.count("*").alias("occupants"), F.sum("n_points").alias("points"), F.avg("confidence").alias("mean_confidence"), F.max("confidence").alias("max_confidence")
    )
    return got.withColumn("per_car", F.col("occupants") / F.col("cars"))


def confidence_history(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Number of each observation and the best confidence so far."""
    order = Window.partitionBy(*keys).orderBy("frame_id", "cand_id")
    return candidates.withColumns({"observation": F.row_number().over(order), "best": F.max("confidence").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def build_up(points: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Points and centroid of each frame, and the mean over a group's frames."""
    got = points.groupBy(*keys, frame).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz"))
    return got.withColumn("mean_n", F.avg("n").over(Window.partitionBy(*keys)))
