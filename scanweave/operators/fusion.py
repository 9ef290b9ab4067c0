"""Camera and LiDAR fusion: points are projected with each camera's calibration and attached to the detection boxes of the same frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import in_image
from .geometry import projected
from .select import first_n

FRAME = ["device_no", "sequence_no", "frame_id"]


def with_calibration(points: DataFrame, calibration: DataFrame) -> DataFrame:
    """Each point once for each camera of its device; the planner broadcasts calibration below its threshold."""
    return points.join(calibration, "device_no")


def attached(points: DataFrame, detections: DataFrame, keys: list[str], width: int = 1920, height: int = 1200) -> DataFrame:
    """``points`` (with ``u, v, depth`` by frame and camera) inside boxes of their frame and camera; a point may be in many.

    Frame and camera are an equi key, so only the range is left to test.
    """
    own = points.where((F.col("depth") > 0) & in_image(width, height))
    inside = (F.col("u") >= F.col("x1")) & (F.col("u") <= F.col("x2")) & (F.col("v") >= F.col("y1")) & (F.col("v") <= F.col("y2"))
    return own.join(detections.select(*keys, "camera", "det_id", "x1", "y1", "x2", "y2"), [*keys, "camera"]).where(inside)


def fused_detections(on_box: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Of each detection the points on it, their depth range ((0, 0) if none) and its mean, their centre and extents."""
    extent = [(F.max(a) - F.min(a)).alias(f"extent_{a}") for a in "xyz"]
    got = on_box.groupBy("det_id").agg(F.count("*").alias("n_points"), F.min("depth").alias("d0"), F.max("depth").alias("d1"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *extent)
    out = detections.select(*keys, "camera", "det_id", "confidence").join(got, "det_id", "left")
    depth = [F.coalesce(d, F.lit(0.0)) for d in ("d0", "d1")]
    return out.select(
        *keys, "camera", "det_id", "confidence", F.coalesce("n_points", F.lit(0)).alias("n_points"), depth[0].alias("depth_min"), depth[1].alias("depth_max"),
        ((depth[0] + depth[1]) / 2).alias("depth_mean"), "mx", "my", "mz", *(f"extent_{a}" for a in "xyz"),
    )


def fusion_summary(points: DataFrame, fused: DataFrame, keys: list[str], width: int = 1920, height: int = 1200) -> DataFrame:
    """By frame and camera: points, points projected into the image, detections, points on boxes, and shares."""
    seen = (F.col("depth") > 0) & in_image(width, height)
    total = points.groupBy(*keys, "camera").agg(F.count("*").alias("total"), F.count_if(F.coalesce(seen, F.lit(False))).alias("projected"))
    boxes = fused.groupBy(*keys, "camera").agg(F.count("*").alias("detections"), F.sum("n_points").alias("on_boxes"))
    both = total.join(boxes, [*keys, "camera"], "left").fillna(0, ["detections", "on_boxes"])
    share = lambda a, b: 100 * F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return both.withColumns({"projected_percent": share("projected", "total"), "on_boxes_percent": share("on_boxes", "projected")})


def fusion_job(frames: DataFrame, points: DataFrame, calibration: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """One job over all frames and cameras. Frames without points or calibration stay, as failures with zero counts."""
    wanted = frames.select(*keys).join(calibration.select("device_no", "camera"), "device_no", "left")
    shot = projected(with_calibration(points, calibration))
    fused = fused_detections(attached(shot, detections, keys), detections, keys)
    summary = fusion_summary(shot, fused, keys)
    out = wanted.join(summary, [*keys, "camera"], "left")
    ok = F.col("total").isNotNull()
    error = F.when(F.col("camera").isNull(), "no calibration").when(~ok, "no points")
    return out.withColumns({"processing_success": ok, "error": error}).fillna(0, ["total", "projected", "detections", "on_boxes"])


def batch_rollup(summary: DataFrame) -> DataFrame:
    """By camera and over all, in one pass."""
    both = summary.rollup("camera").agg(
        F.count("*").alias("frames"), F.count_if("processing_success").alias("ok"), F.sum("on_boxes").alias("on_boxes"), F.avg("projected").alias("mean_projected"), F.grouping("camera").alias("g")
    )
    return both.select(F.when(F.col("g") == 1, "all").otherwise(F.col("camera")).alias("camera"), "frames", "ok", "on_boxes", "mean_projected")


def sequence_catalogue(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames, duration, first and last frame, frames in excellent synchronisation."""
    return frames.groupBy(*keys).agg(
        F.count("*").alias("frames"), (F.max("ts") - F.min("ts")).alias("duration"), F.min_by("frame_id", "ts").alias("first_frame"), F.max_by("frame_id", "ts").alias("last_frame"),
        F.count_if(F.col("sync_quality") == "excellent").alias("excellent"),
    )


def device_ranges(frames: DataFrame, device: str = "device_no") -> DataFrame:
    """Each device's frames."""
    return frames.groupBy(device).agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("frames"), F.sort_array(F.collect_set("frame_id")).alias("ids"))


def detection_rate(frames: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """By camera: detections, frames that have any, mean points, and their rate over all frames."""
    n = frames.select(*keys).distinct().agg(F.count("*").alias("all_frames"))
    got = detections.groupBy("camera").agg(F.count("*").alias("detections"), F.countDistinct(*keys).alias("frames_with"), F.avg("n_points").alias("mean_points"))
    return got.crossJoin(n).withColumn("rate", F.try_divide(F.col("frames_with").cast("double"), F.col("all_frames").cast("double")))


def activity(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Detections by frame, and whether a frame is its group's peak (the first of equals)."""
    each = detections.groupBy(*keys, "frame_id").agg(F.count("*").alias("cars"))
    peak = each.groupBy(*keys).agg(F.max_by("frame_id", F.struct("cars", -F.col("frame_id"))).alias("peak"))
    return each.join(peak, keys).withColumn("is_peak", F.col("frame_id") == F.col("peak")).drop("peak")


def missing_files(frames: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Frames whose file is not in the listing."""
    return frames.join(listing.select(path).distinct(), path, "left_anti")


def camera_comparison(fused: DataFrame, keys: list[str]) -> DataFrame:
    """Points on boxes of the two cameras side by side."""
    return fused.groupBy(*keys).pivot("camera", ["cam0", "cam1"]).agg(F.sum("n_points").cast("long"))


def good_detections(fused: DataFrame, keys: list[str], more_than: int = 20, first: int | None = None) -> DataFrame:
    """Detections with more than so many points, in frame and camera order, and the first so many of them."""
    good = fused.where(F.col("n_points") > more_than).orderBy(*keys, "camera", "det_id")
    return good if first is None else good.limit(first)


def first_camera_detections(fused: DataFrame, keys: list[str], more_than: int = 10, first: int | None = None) -> DataFrame:
    """T9, the variant: of each frame the first detection of the first camera that has any, if it has more than so many points."""
    return good_detections(first_n(fused, keys, ["camera", "det_id"], 1), keys, more_than, first)
