"""Sinks: class tables, metadata, results, tracks and selections, written by Spark's committers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.operators.motion import static_statistics
from scanweave.operators.select import concatenated
from scanweave.operators.stats import bounds_of
from scanweave.operators.tracking import with_age


Writer = Callable[[DataFrame, str], object]
_WRITERS: dict[str, Writer] = {
    "parquet": lambda rows, path: rows.write.mode("overwrite").parquet(path),
    "csv": lambda rows, path: rows.write.mode("overwrite").csv(path, header=True),
    "json": lambda rows, path: rows.write.mode("overwrite").json(path),
}


def register_writer(kind: str, writer: Writer) -> None:
    """§2.12: an exporter for a format, beside those that are there or in place of one."""
    _WRITERS[kind.lower().lstrip(".")] = writer


def formats() -> list[str]:
    """§2.12: the formats that can be written."""
    return sorted(_WRITERS)


def export(results: dict[str, DataFrame], path: str, kind: str = "parquet") -> dict[str, str]:
    """§2.12: each named result in a folder of its own under ``path``, by the exporter of a format; where each went."""
    if kind.lower() not in _WRITERS:
        raise ValueError(f"no writer for {kind}; there are {', '.join(formats())}")
    places = {name: f"{path.rstrip('/')}/{name}" for name in results}
    for name, rows in results.items():
        _WRITERS[kind.lower()](rows, places[name])
    return places


def write_classes(labelled: DataFrame, path: str, label: str = "label") -> None:
    """K1: one partition for each class."""
    labelled.write.mode("overwrite").partitionBy(label).parquet(path)


def cloud_metadata(points: DataFrame, keys: list[str]) -> DataFrame:
    """K2: counts, ranges, rings, and which attributes are there."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), *bounds_of(), F.min("intensity").alias("intensity_min"), F.max("intensity").alias("intensity_max"),
        F.max(F.col("intensity").isNotNull()).alias("has_intensity"), F.sort_array(F.collect_set("ring")).alias("rings"),
    )


def write_metadata(points: DataFrame, keys: list[str], path: str) -> None:
    cloud_metadata(points, keys).write.mode("overwrite").json(path)


def write_results_csv(parts: list[DataFrame], path: str) -> None:
    """K3: results of several jobs, with the union of their columns, sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode("overwrite").csv(path, header=True)


def nested_tracks(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """K4: a row for each track with its detections in order of time."""
    return tracked.groupBy(*keys, "track_id").agg(F.array_sort(F.collect_list(F.struct("ts", "det_id", "camera", "confidence", "cx", "cy", "cz"))).alias("detections"))


def write_json(rows: DataFrame, path: str) -> None:
    """K4: rows as JSON; an empty table leaves an empty folder that says so."""
    rows.write.mode("overwrite").json(path)


def write_models(models: DataFrame, keys: list[str], path: str) -> None:
    """K5: a row for each sequence: how many cars were tracked, and the figures of each."""
    each = F.struct(*(c for c in models.columns if c not in keys))
    models.groupBy(*keys).agg(F.count("*").alias("total_tracked_cars"), F.array_sort(F.collect_list(each)).alias("tracks")).write.mode("overwrite").json(path)


def write_motion(classified: DataFrame, path: str, moving: DataFrame | None = None) -> None:
    """K7: static and dynamic points, and those of ``moving`` as temporal ones, by ``motion_class``; and a row of statistics, even where there are none."""
    kind = F.when(F.col("is_static"), "static").otherwise("dynamic")
    points = classified.withColumn("motion_class", kind)
    if moving is not None:
        points = points.unionByName(moving.withColumn("motion_class", F.lit("temporal")), allowMissingColumns=True)
    points.write.mode("overwrite").partitionBy("motion_class").parquet(f"{path}/points")
    about = static_statistics(classified, [])
    if moving is not None:
        about = about.withColumn("n_temporal", F.lit(moving.count()))
    about.coalesce(1).write.mode("overwrite").json(f"{path}/statistics")


def write_merged(cloud: DataFrame, model: DataFrame, path: str, about: dict | None = None) -> None:
    """K8: a cloud and a model placed in it as one, told apart by ``source``, and a row of counts with what else is known about it."""
    both = concatenated({"cloud": cloud, "model": model})
    both.write.mode("overwrite").parquet(f"{path}/points")
    counts = both.agg(F.count("*").alias("total_points"), F.count_if(F.col("source") == "cloud").alias("original_points"), F.count_if(F.col("source") == "model").alias("model_points"))
    counts.withColumns({k: F.lit(v) for k, v in (about or {}).items()}).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def write_track_cloud(points: DataFrame, keys: list[str], path: str) -> None:
    """K6: a track's points with the colour of their age."""
    with_age(points, keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def save_selection(points: DataFrame, selection_id: str, path: str, note: str | None = None) -> None:
    """K9: a named selection and a row about it; the same name again replaces both."""
    points.write.mode("overwrite").parquet(f"{path}/points/selection_id={selection_id}")
    points.agg(F.count("*").alias("n")).withColumn("note", F.lit(note)).write.mode("overwrite").json(f"{path}/about/selection_id={selection_id}")


def load_selection(spark: SparkSession, selection_id: str, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/points/selection_id={selection_id}")


def list_selections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n BIGINT, note STRING, selection_id STRING").json(f"{path}/about")


def write_occupants(points: DataFrame, path: str) -> None:
    """Points of occupants by car and occupant, coloured by confidence."""
    shade = points.withColumns({"red": F.lit(1.0), "green": 1 - F.col("confidence"), "blue": 1 - F.col("confidence")})
    shade.write.mode("overwrite").partitionBy("car_id", "occupant").parquet(path)


def with_stage(track_points: DataFrame, keys: list[str]) -> DataFrame:
    """The stage colour (0, i / (n - 1), 1 - i / (n - 1)) of each point's detection; snapshot i is ``where(det_ordinal <= i)``."""
    n = track_points.groupBy(*keys).agg(F.max("det_ordinal").alias("__n"))
    t = (F.col("det_ordinal") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))
    return track_points.join(n, keys).withColumns({"red": F.lit(0.0), "green": t, "blue": 1 - t}).drop("__n")


def write_snapshots(track_points: DataFrame, keys: list[str], path: str) -> None:
    with_stage(track_points, keys).write.mode("overwrite").partitionBy(*keys, "det_ordinal").parquet(path)
