"""Predicates over points, boxes, frames and tracks. ``keys`` are the columns that name one cloud; every operator does all clouds in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.scratch import written
from scanweave.schema import SYNC_LEVELS

from .order import exact_quantiles

AXES = ("x", "y", "z")


def norm() -> Column:
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def with_cloud(points: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Points with per-cloud scalars: two-phase aggregates joined back, so no cloud is gathered in one task.

    The scalars are written, so the planner knows them for the smaller side and never gathers the points on the driver in their stead."""
    return points.join(written(points.groupBy(*keys).agg(*aggregates), "scalars"), keys) if keys else points.crossJoin(points.agg(*aggregates))


#: Rows of a stated set that go into the plan as literals, and rows of a block of a larger one.
STATED = 200


def with_each(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """Every row of a stated set (boxes, transforms) beside every row.

    A set of at most ``STATED`` rows is a literal, so nothing is joined or shuffled. A larger one is dealt to blocks, each an array in one row; rows are
    read once and joined to the blocks by number, which the planner broadcasts below its threshold.
    """
    fields = stated.schema.fields
    put = lambda each: each.select(*rows.columns, *(F.col(f"__each.{f.name}").alias(f.name) for f in fields))
    few = stated.limit(STATED + 1).collect()
    if len(few) > STATED:
        blocks = -(-stated.count() // STATED)
        dealt = stated.groupBy(F.pmod(F.xxhash64(*stated.columns), F.lit(blocks)).cast("int").alias("__b")).agg(F.collect_list(F.struct(*stated.columns)).alias("__some"))
        each = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__b")
        return put(each.withColumn("__each", F.explode("__some")))
    if not few:
        return put(rows.withColumn("__each", F.lit(None).cast(stated.schema))).where("false")
    literal = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True))) for r in few))
    return put(rows.withColumn("__each", F.explode(literal)))


def _distance_limit(points: DataFrame, keys: list[str], quantile: float, accuracy: int | None) -> DataFrame:
    d = points.withColumn("d", norm())
    if accuracy is None:
        return d.join(written(exact_quantiles(d, keys, {"d_max": ("d", quantile)}), "limits"), keys)
    return with_cloud(d, keys, F.percentile_approx("d", quantile, accuracy).alias("d_max"))


def range_outliers(points: DataFrame, keys: list[str], quantile: float = 0.95, accuracy: int | None = None) -> DataFrame:
    """points nearer to the origin than the quantile of distance. ``accuracy`` turns to the approximate quantile, in one pass."""
    return _distance_limit(points, keys, quantile, accuracy).where("d < d_max")


def range_report(points: DataFrame, keys: list[str], quantile: float = 0.95) -> DataFrame:
    """F1's report: threshold, points kept and removed."""
    d = _distance_limit(points, keys, quantile, None)
    return d.groupBy(*keys).agg(F.max("d_max").alias("threshold"), F.count_if(F.col("d") < F.col("d_max")).alias("kept"), F.count_if(F.col("d") >= F.col("d_max")).alias("removed"))


def height_band(points: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """inclusive band of height above the cloud's lowest point."""
    return with_cloud(points, keys, F.min("z").alias("z_min")).where((F.col("z") >= F.col("z_min") + low) & (F.col("z") <= F.col("z_min") + high)).drop("z_min")


def in_box(box: dict[str, tuple[float, float]] | None = None, prefix: str = "") -> Column:
    """inside six inclusive faces, given as numbers or as columns ``x_min`` and so on. Numbers reach the scan as pushed filters."""
    ends = (lambda a: tuple(map(F.lit, box[a]))) if box else (lambda a: (F.col(f"{prefix}{a}_min"), F.col(f"{prefix}{a}_max")))
    tests = [(F.col(a) >= ends(a)[0]) & (F.col(a) <= ends(a)[1]) for a in AXES]
    return tests[0] & tests[1] & tests[2]


def box_filter(points: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    return points.where(in_box(box))


def box_count(points: DataFrame, keys: list[str], box: dict[str, tuple[float, float]]) -> DataFrame:
    """F4."""
    return points.groupBy(*keys).agg(F.count_if(in_box(box)).alias("inside"), F.count("*").alias("total"))


def quality_gate(points: DataFrame, keys: list[str], min_points: int = 100) -> DataFrame:
    """verdict and reasons for each cloud."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = points.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad("x") | bad("y") | bad("z")).alias("n_bad"))
    few, wrong = F.col("n") < min_points, F.col("n_bad") > 0
    reasons = F.filter(F.array(F.when(few, "too few points"), F.when(wrong, "values that are not finite")), lambda r: r.isNotNull())
    return found.select(*keys, "n", "n_bad", (~few & ~wrong).alias("ok"), F.array_join(reasons, "; ").alias("reasons"))


def artefact_cut(points: DataFrame) -> DataFrame:
    """without returns from the sensor itself and beyond its range."""
    near = (F.abs("x") <= 0.1) & (F.abs("y") <= 0.1) & (F.abs("z") <= 0.1)
    return points.where(~near & (F.abs("x") < 200) & (F.abs("y") < 200) & (F.abs("z") < 50))


def frame_selection(frames: DataFrame, first: int | None = None, last: int | None = None, cameras: list[str] | None = None, **equal) -> DataFrame:
    """inclusive frame range, cameras, and equality on other columns."""
    test = F.lit(True)
    if first is not None:
        test &= F.col("frame_id") >= first
    if last is not None:
        test &= F.col("frame_id") <= last
    if cameras is not None:
        test &= F.col("camera").isin(cameras)
    for name, value in equal.items():
        test &= F.col(name) == value
    return frames.where(test)


def sync_level(quality: Column) -> Column:
    level = F.lit(None).cast("int")
    for name, n in SYNC_LEVELS.items():
        level = F.when(quality == name, n).otherwise(level)
    return level


def sync_filter(frames: DataFrame, minimum: str) -> DataFrame:
    """F8: synchronisation at least ``minimum``. An unknown quality is the worst, an unknown minimum the best."""
    return frames.where(F.coalesce(sync_level(F.col("sync_quality")), F.lit(0)) >= SYNC_LEVELS.get(minimum, max(SYNC_LEVELS.values())))


def in_front(projected: DataFrame) -> DataFrame:
    """F9."""
    return projected.where("depth > 0")


def in_image(width: float | Column = 1920, height: float | Column = 1200) -> Column:
    """F10."""
    return (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)


def car_interior(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """points in the box of a car's interior around its centre (``cx, cy, cz``)."""
    joined = points.join(centres, keys)
    inside = F.lit(True)
    for a, lo, hi in (("x", -2.5, 0.5), ("y", -1.0, 1.0), ("z", 0.5, 2.0)):
        inside &= (F.col(a) - F.col(f"c{a}") >= lo) & (F.col(a) - F.col(f"c{a}") <= hi)
    return joined.where(inside)


def track_gate(tracks: DataFrame, min_detections: int = 2, min_points: int = 0) -> DataFrame:
    """F12; the usual gates are (2, 0), (2, 10), (2, 20) and (3, 20)."""
    return tracks.where((F.col("n_detections") >= min_detections) & (F.col("n_points") >= min_points))


def box_problems(boxes: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``errors`` (inverted or not finite) and ``warnings`` (apart from the cloud) of each box; ``bounds`` has columns ``lo_x, hi_x`` and so on."""
    rules, warns = [], []
    for a in AXES:
        lo, hi = F.col(f"{a}_min"), F.col(f"{a}_max")
        finite = ~(lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi) | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf")))
        rules += [F.when(~finite, f"{a} not finite"), F.when(finite & (lo >= hi), f"{a} inverted")]
        if bounds is not None:
            warns.append(F.when(finite & ((hi < F.col(f"lo_{a}")) | (lo > F.col(f"hi_{a}"))), f"{a} apart"))
    said = lambda r: F.array_join(F.filter(F.array(*r), lambda x: x.isNotNull()), ",")
    out = boxes.withColumn("errors", said(rules))
    return out.crossJoin(bounds).withColumn("warnings", said(warns)) if bounds is not None else out


def transform_problems(transforms: DataFrame) -> DataFrame:
    """F14."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rules = [F.when(bad("cx") | bad("cy") | bad("cz"), "centre"), F.when(bad("scale") | (F.col("scale") <= 0), "scale"), F.when(bad("rotation_deg"), "rotation")]
    return transforms.withColumn("errors", F.array_join(F.filter(F.array(*rules), lambda x: x.isNotNull()), ","))


def semantic_split(points: DataFrame, legacy_other: bool = False) -> DataFrame:
    """flags of each semantic class, and vehicle = exterior or interior. ``legacy_other`` counts humans as other, too."""
    c = F.col("semantic_class")
    other = c.isin(3, 5) if legacy_other else c == 5
    return points.withColumns({"is_exterior": c == 1, "is_interior": c == 2, "is_human": c == 3, "is_seat": c == 4, "is_other": other, "is_vehicle": c.isin(1, 2)})


def count_changes(counts: DataFrame, keys: list[str], order: str, share: float = 0.001) -> DataFrame:
    """F16: whether a count moved by more than a share of the total since the one before; the first always did."""
    before = F.lag("inside").over(Window.partitionBy(*keys).orderBy(order))
    return counts.withColumn("changed", F.coalesce(F.abs(F.col("inside") - before) > share * F.col("total"), F.lit(True)))
