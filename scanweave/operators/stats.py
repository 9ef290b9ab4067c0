"""Grouped statistics of clouds, selections, fusion results and tracks. Partial and final aggregation are Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import with_each
from .geometry import voxels
from .neighbors import in_boxes
from .order import exact_quantiles

AXES = ("x", "y", "z")


def bounds_of() -> list[Column]:
    return [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """A1."""
    return points.groupBy(*keys).agg(*bounds_of())


def stage_counts(labelled: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """A2: rows per flag."""
    return labelled.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(f).alias(f"n_{f}") for f in flags))


def class_statistics(points: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """A3: per class counts, bounds, extents, and its share of the cloud."""
    own = points.groupBy(*keys, label).agg(F.count("*").alias("n"), *bounds_of(), *((F.max(a) - F.min(a)).alias(f"extent_{a}") for a in AXES))
    total = points.groupBy(*keys).agg(F.count("*").alias("total"))
    return own.join(total, keys).withColumn("percent", 100.0 * F.col("n") / F.col("total")).drop("total")


def _volume(floor: float | None = None) -> Column:
    v = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")) * (F.col("z_max") - F.col("z_min"))
    return v if floor is None else F.greatest(v, F.lit(floor))


def selection_statistics(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A4: for each cloud and box (``box_id, x_min .. z_max``): totals, share, volume, density, and of the points in it centroid, spread and bounds. Inverted
    boxes give an error row.

    Points meet boxes by grid cell; each cloud has a row for each of the stated boxes.
    """
    valid = boxes.withColumn("valid", (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max")) & (F.col("z_min") < F.col("z_max")))
    good = valid.where("valid")
    stats = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("mean", F.avg), ("sigma", F.stddev_pop))]
    inside = in_boxes(points, good, keys).groupBy(*keys, "box_id").agg(F.count("*").alias("selected"), *stats, *bounds_of())
    total = with_each(points.groupBy(*keys).agg(F.count("*").alias("total")), good.select("box_id", _volume().alias("volume")))
    got = total.join(inside, [*keys, "box_id"], "left").fillna(0, ["selected"])
    got = got.withColumns({"percent": 100.0 * F.col("selected") / F.col("total"), "density": F.col("selected") / F.col("volume"), "error": F.lit(None).cast("string")})
    return got.unionByName(valid.where("not valid").select("box_id", F.lit("invalid bounds").alias("error")), allowMissingColumns=True)


def model_statistics(points: DataFrame, keys: list[str]) -> DataFrame:
    """A5: centroid, bounds, and density with a floor of the volume."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"mean_{a}") for a in AXES), *bounds_of()).withColumn("density", F.col("n") / _volume(0.001))


def default_cubes(points: DataFrame, keys: list[str], size: tuple[float, float, float] = (4.0, 4.0, 2.0), shrink: float = 0.1) -> DataFrame:
    """A cube around the mean, and the bounds shrunk by a share of their size on each side; a cloud whose points have no coordinates, and without
    keys an empty one, gives unit cubes."""
    own = points.groupBy(*keys).agg(*bounds_of(), *(F.avg(a).alias(f"m{a}") for a in AXES))
    new = {}
    for a, s in zip(AXES, size, strict=True):
        room = shrink * (F.col(f"{a}_max") - F.col(f"{a}_min"))
        new |= {f"cube_{a}_min": F.col(f"m{a}") - s / 2, f"cube_{a}_max": F.col(f"m{a}") + s / 2, f"inner_{a}_min": F.col(f"{a}_min") + room, f"inner_{a}_max": F.col(f"{a}_max") - room}
    unit = lambda n: F.lit(1.0 if n.endswith("max") else 0.0)
    return own.select(*keys, *(F.coalesce(c, unit(n)).alias(n) for n, c in new.items()))


def centres(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median centre."""
    mean = points.groupBy(*keys).agg(*(F.avg(a).alias(f"mean_{a}") for a in AXES))
    return mean.join(exact_quantiles(points, keys, {f"median_{a}": (a, 0.5) for a in AXES}), keys)


def occupancy(points: DataFrame, keys: list[str], size: float = 0.1) -> DataFrame:
    """Points by voxel."""
    return voxels(points, keys, size).groupBy(*keys, "gx", "gy", "gz").agg(F.count("*").alias("n"))


def down_sampled(points: DataFrame, keys: list[str], size: float = 0.1) -> DataFrame:
    """A10: the mean point of each voxel; ``point_id`` is the least in it."""
    own = voxels(points, keys, size, half_below=True)
    return own.groupBy(*keys, "gx", "gy", "gz").agg(F.min("point_id").alias("point_id"), *(F.avg(a).alias(a) for a in AXES), F.count("*").alias("n"))


def ring_statistics(points: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """A30."""
    return points.groupBy(*keys).agg(F.min(ring).alias("ring_min"), F.max(ring).alias("ring_max"), F.array_join(F.sort_array(F.collect_set(ring)), ",").alias("rings"))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins, 0 below and bins + 1 beyond."""
    return rows.groupBy(*keys, F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def growth_rate(progress: DataFrame, keys: list[str]) -> DataFrame:
    """Mean growth of the cumulative count per step, null for a single step."""
    got = progress.groupBy(*keys).agg(F.max_by("cumulative", "step").alias("last"), F.min_by("cumulative", "step").alias("first"), F.count("*").alias("n"))
    return got.select(*keys, F.try_divide((F.col("last") - F.col("first")).cast("double"), (F.col("n") - 1).cast("double")).alias("growth"))


def class_comparison(a: DataFrame, b: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Counts by class of two labellings side by side."""
    count = lambda d, n: d.groupBy(*keys, label).agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), [*keys, label], "full_outer").fillna(0, ["n_a", "n_b"])
    return both.withColumn("difference", F.col("n_b") - F.col("n_a"))
