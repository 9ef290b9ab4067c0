"""Rigid transforms, projection, voxel indices, colours and box arithmetic, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import with_cloud, with_each
from .neighbors import finite


def clamp(value: Column, low: float, high: float) -> Column:
    """P6; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def normal_rotation(degrees: Column) -> Column:
    """In [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def rotated(points: DataFrame, cx: Column, cy: Column, degrees: Column) -> DataFrame:
    """About the vertical axis through (cx, cy)."""
    a, dx, dy = F.radians(degrees), F.col("x") - cx, F.col("y") - cy
    return points.withColumns({"x": cx + dx * F.cos(a) - dy * F.sin(a), "y": cy + dx * F.sin(a) + dy * F.cos(a)})


def scaled(points: DataFrame, cx: Column, cy: Column, cz: Column, by: Column) -> DataFrame:
    """About a centre, all axes alike."""
    return points.withColumns({a: c + (F.col(a) - c) * by for a, c in (("x", cx), ("y", cy), ("z", cz))})


def transformed(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Every transform (``transform_id, cx, cy, cz, scale, rotation_deg``) of every point: scale, then rotate."""
    both = with_each(points, transforms.select("transform_id", "cx", "cy", "cz", "scale", "rotation_deg"))
    c = [F.col(k) for k in ("cx", "cy", "cz")]
    return rotated(scaled(both, *c, F.col("scale")), c[0], c[1], F.col("rotation_deg"))


def moved(points: DataFrame, old: tuple[float, float, float], new: tuple[float, float, float]) -> DataFrame:
    """P4."""
    return points.withColumns({a: F.col(a) + (n - o) for a, o, n in zip("xyz", old, new, strict=True)})


def transform_of_box(boxes: DataFrame) -> DataFrame:
    """P5: centre and clamped scale of a box."""
    mid = {f"c{a}": (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xyz"}
    least = F.least(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    return boxes.withColumns(mid | {"scale": clamp(least, 0.1, 3.0), "rotation_deg": F.lit(0.0)})


#: A prime below 2**31, so that a square stays a long, and odd multipliers without a meaning.
_PRIME, _MIX = 2147483647, (48271, 69621, 40692, 16807)


def counter_uniform(id_col: str, stream: int, seed: int = 42) -> Column:
    """A number in (0, 1) for each id, by three squarings of a counter modulo a prime: the same whatever the partitioning, in any SQL engine."""
    x = F.pmod(F.col(id_col), F.lit(_PRIME)) * _MIX[0] + (seed * _MIX[1] + stream * _MIX[2] + 1)
    for k in range(3):
        x = F.pmod(x, F.lit(_PRIME))
        x = x * x + x * _MIX[3] + (k + 1) * _MIX[1]
    return (F.pmod(x, F.lit(_PRIME)) + 0.5) / _PRIME


def jittered(points: DataFrame, sigma: float, seed: int = 42, id_col: str = "point_id") -> DataFrame:
    """Gaussian noise on each axis from the point's id, the axis and the seed, by the transform of Box and Muller. A null id has no noise to go by."""
    normal = lambda k: F.sqrt(-2 * F.log(counter_uniform(id_col, 2 * k, seed))) * F.cos(2 * math.pi * counter_uniform(id_col, 2 * k + 1, seed))
    return points.withColumns({a: F.col(a) + normal(k) * sigma for k, a in enumerate("xyz")})


def projected(points: DataFrame) -> DataFrame:
    """Pinhole projection by joined calibration columns ``r11..r33, t1..t3, fx, fy, cx0, cy0``: ``u, v`` (float) and ``depth``."""
    cam = [F.col(f"r{k}1") * F.col("x") + F.col(f"r{k}2") * F.col("y") + F.col(f"r{k}3") * F.col("z") + F.col(f"t{k}") for k in (1, 2, 3)]
    out = points.withColumns({"xc": cam[0], "yc": cam[1], "depth": cam[2]})
    safe = F.when(F.col("depth") > 0, F.col("depth"))
    return out.withColumns({"u": (F.col("fx") * F.col("xc") / safe + F.col("cx0")).cast("float"), "v": (F.col("fy") * F.col("yc") / safe + F.col("cy0")).cast("float")}).drop("xc", "yc")


def above_plane(points: DataFrame) -> DataFrame:
    """Height above the joined plane ``a, b, c``."""
    return points.withColumn("height", F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")))


def voxels(points: DataFrame, keys: list[str], size: float = 0.1, half_below: bool = False) -> DataFrame:
    """P10: voxel numbers ``gx, gy, gz`` (long) from the cloud's least corner, or from half a voxel below it. Points whose coordinates are not all finite
    numbers have no voxel: they are left out, and the corner is that of the others."""
    low = with_cloud(finite(points), keys, *(F.min(a).alias(f"lo_{a}") for a in "xyz"))
    shift = size / 2 if half_below else 0.0
    return low.withColumns({f"g{a}": F.floor((F.col(a) - (F.col(f"lo_{a}") - shift)) / size).cast("long") for a in "xyz"}).drop("lo_x", "lo_y", "lo_z")


def selection_colour(inside: Column) -> Column:
    """P11."""
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return F.when(inside, rgb(0, 255, 0)).otherwise(rgb(128, 128, 128))


def _rgb(points: DataFrame) -> Column | None:
    """Whether a point has all three colours; None if the table has no such columns."""
    return F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull() if {"r", "g", "b"} <= set(points.columns) else None


def coloured(points: DataFrame, by: str = "intensity") -> DataFrame:
    """``scalar`` to colour by, ring or intensity where it is there and a number, else the height; by ``rgb`` a point that has all three colours has
    no scalar, and all points have ``red, green, blue`` clipped to 0..255 where they have colours."""
    has, height = _rgb(points), F.col("z").cast("double")
    value = F.col(by).cast("double") if by in ("ring", "intensity") and by in points.columns else F.lit(None).cast("double")
    scalar = F.coalesce(F.when(~F.isnan(value), value), height)
    if by == "rgb" and has is not None:
        scalar = F.when(~has, height)
    byte = lambda c: clamp(F.col(c).cast("double"), 0, 255).cast("int") if has is not None else F.lit(None).cast("int")
    return points.withColumns({"scalar": scalar} | ({"red": byte("r"), "green": byte("g"), "blue": byte("b")} if by == "rgb" else {}))


def depth_colour(points: DataFrame, keys: list[str]) -> DataFrame:
    """``shade``, depth scaled to 0..1 in each frame, and ``red, green, blue``: near points red, far ones blue; all green, and no shade, where all
    depths are one."""
    near = with_cloud(points, keys, F.min("depth").alias("d0"), F.max("depth").alias("d1"))
    out = near.withColumn("shade", F.try_divide(F.col("depth") - F.col("d0"), F.col("d1") - F.col("d0"))).drop("d0", "d1")
    byte = lambda c: F.coalesce((255 * c).cast("int"), F.lit(0))
    return out.withColumns({"red": byte(1 - F.col("shade")), "green": F.when(F.col("shade").isNull(), 255).otherwise(0), "blue": byte(F.col("shade"))})


def scaled_features(points: DataFrame, keys: list[str]) -> DataFrame:
    """Six features: z-scores of the coordinates over the whole cloud, and three of colour: red, green and blue of a cloud that has them, by 255 if any
    is over 1; else intensity scaled to 0..1, three times; else zeros."""
    stats = [f(a).alias(f"__{n}_{a}") for a in "xyz" for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    has, light = _rgb(points), F.col("intensity").cast("double") if "intensity" in points.columns else F.lit(None).cast("double")
    tone = [F.col(c).cast("double") if has is not None else F.lit(None).cast("double") for c in "rgb"]
    stats += [F.min(light).alias("__i0"), F.max(light).alias("__i1"), F.max(F.greatest(*tone)).alias("__top"), F.min(has if has is not None else F.lit(False)).alias("__rgb")]
    all_ = with_cloud(points, keys, *stats)
    z = {f"f{a}": (F.col(a) - F.col(f"__m_{a}")) / (F.col(f"__s_{a}") + 1e-8) for a in "xyz"}
    grey = F.coalesce((light - F.col("__i0")) / (F.col("__i1") - F.col("__i0") + 1e-8), F.lit(0.0))
    by = F.when(F.col("__top") > 1, 255.0).otherwise(1.0)
    own = {n: F.when(F.col("__rgb"), t / by).otherwise(grey) for n, t in zip(("fr", "fg", "fb"), tone, strict=True)}
    return all_.withColumns(z | own).select(*points.columns, "fx", "fy", "fz", "fr", "fg", "fb")


def box_geometry(detections: DataFrame, pad: float = 20, width: int = 1920, height: int = 1200) -> DataFrame:
    """Centre, size and the padded crop inside the image; an invalid box crops to [0, 0, 100, 100]."""
    ok = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    edge = {
        "crop_x1": (F.greatest(F.col("x1") - pad, F.lit(0.0)), 0), "crop_y1": (F.greatest(F.col("y1") - pad, F.lit(0.0)), 0),
        "crop_x2": (F.least(F.col("x2") + pad, F.lit(float(width))), 100), "crop_y2": (F.least(F.col("y2") + pad, F.lit(float(height))), 100),
    }
    crop = {k: F.when(ok, c.cast("int")).otherwise(d) for k, (c, d) in edge.items()}
    return detections.withColumns({"bx": (F.col("x1") + F.col("x2")) / 2, "by": (F.col("y1") + F.col("y2")) / 2, "bw": F.col("x2") - F.col("x1"), "bh": F.col("y2") - F.col("y1")} | crop)


def placements(bounds: DataFrame) -> DataFrame:
    """Places for a figure in each cloud's bounds (``x_min`` ...): under the roof, on the floor, in the driver's seat."""
    mid = {a: (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xy"}
    dx, dy = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return bounds.withColumns(
        {"roof_x": mid["x"], "roof_y": mid["y"], "roof_z": F.col("z_max") - 0.3, "floor_x": mid["x"], "floor_y": mid["y"], "floor_z": F.col("z_min") + 0.1}
        | {"seat_x": F.col("x_min") + 0.3 * dx, "seat_y": F.col("y_min") + 0.4 * dy, "seat_z": F.col("z_max") - 0.1}
    )


def fit_scale(bounds: DataFrame) -> DataFrame:
    """P17."""
    return bounds.withColumn("fit", clamp(0.8 * (F.col("z_max") - F.col("z_min")) / 1.3, 0.5, 2.0))


def confidence_colour(confidence: Column) -> Column:
    """P18."""
    return F.struct(F.lit(1.0).alias("r"), (1 - confidence).alias("g"), (1 - confidence).alias("b"))
