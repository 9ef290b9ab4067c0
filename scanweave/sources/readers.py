"""Sources: point files, frame catalogues, calibration, detections, tracking summaries and class tables, a directory or many at once.

Rows that can't be read go to a rejects output where one is named; nothing is invented for them. Missing intensity is null unless a fill is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.functions.scratch import written
from scanweave.schema import CALIBRATION, CATALOGUE

_POINT = "file STRING, point_id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, intensity FLOAT"


def _with_line(raw: DataFrame) -> DataFrame:
    """Lines of text files with ``file`` and ``line``, their number in it from 0. A block of a file is numbered by itself, in the order it is read in,
    from where the file's blocks before it end; so a file of any size is many tasks."""
    own = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    sizes = own.groupBy("file", "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("file", "__block", F.coalesce(before, F.lit(0)).alias("__first"))
    number = F.row_number().over(Window.partitionBy("file", "__block").orderBy("__at")) - 1
    return own.withColumn("__own", number).join(first, ["file", "__block"]).withColumn("line", F.col("__first") + F.col("__own")).drop("__block", "__at", "__own", "__first")


def _ascii_numbers(line: Column) -> tuple[dict[str, Column], Column]:
    """Coordinates and intensity of a line, and whether it holds no point."""
    part = F.split(F.trim(line), "\\s+")
    number = lambda k: F.get(part, F.lit(k)).try_cast("double")
    got = {"x": number(0), "y": number(1), "z": number(2), "intensity": number(3).cast("float")}
    bad = line.startswith("#") | got["x"].isNull() | got["y"].isNull() | got["z"].isNull() | ((F.size(part) > 3) & got["intensity"].isNull())
    return got, bad


def read_pcd_ascii(spark: SparkSession, path: str | list[str], fill_intensity: float | None = None, rejects: bool = False) -> DataFrame:
    """``file, point_id`` (line number), ``x, y, z, intensity`` of ASCII point files; with ``rejects`` the lines of data that hold no point.

    Files are read line by line, a large one by many tasks; blocks of it are numbered apart. ``read_pcd`` tells which files hold no point at all.
    """
    raw = _with_line(spark.read.text(path))
    head = raw.where(F.lower(F.trim("value")) == "data ascii").groupBy("file").agg(F.min("line").alias("head"))
    body = raw.join(head, "file").where((F.col("line") > F.col("head")) & (F.trim("value") != ""))
    numbers, bad = _ascii_numbers(F.col("value"))
    if rejects:
        return body.where(bad).select("file", "line", "value")
    intensity = numbers.pop("intensity")
    intensity = intensity if fill_intensity is None else F.coalesce(intensity, F.lit(fill_intensity).cast("float"))
    return body.where(~bad).select("file", F.col("line").cast("long").alias("point_id"), *(c.alias(n) for n, c in numbers.items()), intensity.alias("intensity"))


#: Bytes of a header that is looked for, and records that a task reads from a binary file at once.
HEADER_BYTES, RECORDS = 65_536, 1_000_000
_KINDS = {"f4", "f8", "i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8"}


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", path))
    return system.open_input_file(place)


def _pcd_header(data: bytes) -> tuple[dict[str, list[str]], int]:
    """Words by the first word of each line, up to the line of DATA, and where that ends; an error for what is no header."""
    fields: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in fields:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("no DATA line")
        words = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            fields[words[0].upper()] = words[1:]
    return fields, at


def _layout(fields: dict[str, list[str]]) -> np.dtype:
    names = fields.get("FIELDS", ["x", "y", "z"])
    counts = [int(c) for c in fields.get("COUNT", ["1"] * len(names))]
    kinds = [f"{t.lower()}{s}" for t, s in zip(fields.get("TYPE", ["F"] * len(names)), fields.get("SIZE", ["4"] * len(names)), strict=True)]
    if not set(kinds) <= _KINDS:
        raise ValueError(f"unknown types {' '.join(sorted(set(kinds) - _KINDS))}")
    return np.dtype([(n, f"<{k}", (c,)) if c != 1 else (n, f"<{k}") for n, k, c in zip(names, kinds, counts, strict=True)])


def _number(word: bytes) -> bool:
    try:
        float(word)
        return True
    except ValueError:
        return False


def _any_point(f, at: int) -> bool:
    """Whether an ASCII file holds a point from ``at`` on; it is read until the first, so mostly a few lines."""
    f.seek(at)
    rest = b""
    while block := f.read(HEADER_BYTES):
        *lines, rest = (rest + block).split(b"\n")
        if any(len(w := x.split()) >= 3 and not x.startswith(b"#") and all(map(_number, w[:4])) for x in lines):
            return True
    return len(w := rest.split()) >= 3 and not rest.startswith(b"#") and all(map(_number, w[:4]))


_ABOUT = "file STRING, kind STRING, head BIGINT, records BIGINT, fields MAP<STRING, ARRAY<STRING>>, error STRING"


def pcd_files(listed: DataFrame) -> DataFrame:
    """``file, kind, head, records, fields, error`` of point files (``path, length``): from the first bytes of each, in tasks. A damaged header, a kind that
    is neither ASCII nor binary, and a file without a point have an error. Spark does not list files of no bytes."""

    def about(path: str, length: int) -> tuple:
        kind, at, records, fields, error = None, 0, 0, None, None
        try:
            with _opened(path) as f:
                fields, at = _pcd_header(f.read(HEADER_BYTES))
                kind = (" ".join(fields["DATA"]) or "nothing").lower()
                if kind == "ascii":
                    error = None if _any_point(f, at) else "no points"
                elif kind == "binary":
                    size = _layout(fields).itemsize
                    records = min((length - at) // size, int(fields.get("POINTS", ["0"])[0]) or 2**62) if size else 0
                    error = None if records else "no points"
                else:
                    error = f"not ascii or binary: {kind}"
        except (ValueError, TypeError, OSError, IndexError) as e:
            error = f"damaged: {e}"
        return path, kind, at, records, fields, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([about(p, n) for p, n in zip(b["path"], b["length"], strict=True)], columns=["file", "kind", "head", "records", "fields", "error"])

    return listed.select("path", "length").mapInPandas(run, _ABOUT)


def pcd_records(files: DataFrame, records: int = RECORDS) -> DataFrame:
    """The points of binary files of ``pcd_files``, little-endian records as the header lays them out; a cut-off record ends a file, missing coordinates
    are 0. A task reads ranges of records, so a large file is many tasks."""
    ranges = files.where("kind = 'binary' and error is null").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(records).cast("long"))))
    # a fixed number, as ranges are small rows that would be put together again
    ranges = ranges.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                record = _layout({k: list(v) for k, v in dict(r.fields).items()})
                with _opened(r.file) as f:
                    for first in range(r.first, min(r.first + records, r.records), 100_000):
                        n = min(100_000, r.first + records - first, r.records - first)
                        f.seek(r.head + first * record.itemsize)
                        rows = np.frombuffer(f.read(n * record.itemsize), record)
                        value = lambda c, missing: rows[c].reshape(len(rows), -1)[:, 0].astype(float) if c in record.names else np.full(len(rows), missing)  # noqa: B023, E731
                        yield pd.DataFrame({"file": r.file, "point_id": np.arange(first, first + len(rows)), "x": value("x", 0.0), "y": value("y", 0.0), "z": value("z", 0.0), "intensity": value("intensity", np.nan).astype("float32")})

    return ranges.select("file", "head", "records", "fields", "first").mapInPandas(run, _POINT)


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files with their lengths; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _no_error(points: DataFrame) -> DataFrame:
    return points.withColumn("error", F.lit(None).cast("string"))


def _errors(files: DataFrame) -> DataFrame:
    return files.where("error is not null").select("file", *(F.lit(None).cast(t).alias(n) for n, t in (("point_id", "long"), *((a, "double") for a in "xyz"), ("intensity", "float"))), "error")


def read_pcd_binary(spark: SparkSession, path: str | list[str], records: int = RECORDS) -> DataFrame:
    """Points of binary files, as ``pcd_records`` has them; a row with its ``error`` for each file that is none."""
    files = pcd_files(_listed(spark, path))
    files = files.withColumn("error", F.when(F.col("kind") != "binary", F.concat(F.lit("not binary: "), "kind")).otherwise(F.col("error")))
    return _no_error(pcd_records(files, records)).unionByName(_errors(files))


def read_point_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``file, point_id`` (the row's place in its file), coordinates named x, point.x or data.x, optional intensity, and colours if all three are there; no coordinates is an error."""
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}

    def pick(*options: str) -> Column | None:
        return next((F.col(f"`{names[o]}`") for o in options if o in names), None)

    xyz = [pick(c, f"point.{c}", f"data.{c}") for c in "xyz"]
    if any(c is None for c in xyz):
        raise ValueError(f"no coordinates among {raw.columns}")
    out = {c: v.try_cast("double") for c, v in zip("xyz", xyz, strict=True)}
    light = pick("intensity", "i", "point.intensity", "data.intensity")
    out["intensity"] = light.try_cast("float") if light is not None else F.lit(None).cast("float")
    rgb = [[pick(f"{p}{c}") for c in "rgb"] for p in ("", "point.", "data.", "color_")]
    found = next((t for t in rgb if all(c is not None for c in t)), None)
    out |= {c: (found[k].try_cast("smallint") if found else F.lit(None).cast("smallint")) for k, c in enumerate("rgb")}
    placed = _with_line(raw)
    return placed.select("file", F.col("line").cast("long").alias("point_id"), *(v.alias(n) for n, v in out.items()))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row for each frame and camera of correspondence files; a frame without any camera keeps a row with a null camera."""
    raw = spark.read.schema(CATALOGUE).json(path, multiLine=True)
    f = raw.select(F.posexplode("correspondence_frames").alias("pos", "f")).select("pos", "f.*")
    camera = lambda n: F.struct(F.lit(n).alias("camera"), F.col(f"{n}.file_path").alias("image_path"), F.col(f"{n}.timestamp").alias("image_ts"))
    here = F.filter(F.array(F.when(F.col("cam0").isNotNull(), camera("cam0")), F.when(F.col("cam1").isNotNull(), camera("cam1"))), lambda c: c.isNotNull())
    flat = f.withColumn("c", F.explode_outer(here))
    return flat.select(
        "pos", "frame_id", "device_id", "sequence_id", "intersection_id", "reference_timestamp", F.timestamp_micros((F.col("reference_timestamp") * 1_000_000).cast("long")).alias("event_time"),
        F.col("lidar.file_path").alias("lidar_path"), F.col("lidar.timestamp").alias("lidar_ts"), "c.camera", "c.image_path", "c.image_ts", F.col("synchronization.sync_quality").alias("sync_quality"),
    )


def read_calibration(spark: SparkSession, path: str, width: int = 1920, height: int = 1200) -> DataFrame:
    """A row for each device (the file's stem) and camera; missing cameras are left out."""
    raw = spark.read.schema(CALIBRATION).json(path, multiLine=True).withColumn("device_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))
    cams = F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("camera"), F.col(f"{c}.intrinsic").alias("k"), F.col(f"{c}.extrinsic").alias("e"))) for c, n in (("cam_0", "cam0"), ("cam_1", "cam1")))), lambda c: c.isNotNull())
    one = raw.select("device_id", F.explode(cams).alias("c"))
    at = lambda m, i, j: F.col(f"c.{m}")[i][j]
    r = [at("e", i, j).alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)]
    t = [at("e", i, 3).alias(f"t{i + 1}") for i in range(3)]
    return one.select("device_id", "c.camera", at("k", 0, 0).alias("fx"), at("k", 1, 1).alias("fy"), at("k", 0, 2).alias("cx0"), at("k", 1, 2).alias("cy0"), *r, *t, F.lit(width).alias("width"), F.lit(height).alias("height"))


def read_detections(spark: SparkSession, path: str, class_id: int | None = 2) -> DataFrame:
    """Detections as Parquet, of one class (cars) unless that is None."""
    raw = spark.read.parquet(path)
    return raw if class_id is None else raw.where(F.col("class_id") == class_id)


def manual_box(spark: SparkSession, camera: str, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """A hand-drawn box as a detection for every frame that it is joined to."""
    return spark.range(1).select(F.col("id").alias("det_id"), F.lit(camera).alias("camera"), *(F.lit(float(v)).alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))), F.lit(1.0).alias("confidence"), F.lit(2).alias("class_id"))


def read_tracking_summary(spark: SparkSession, path: str) -> DataFrame:
    """A row for each track of a summary file that maps track ids to their figures."""
    track = "STRUCT<num_detections: BIGINT, total_points: BIGINT, duration: DOUBLE, centroid: ARRAY<DOUBLE>>"
    raw = spark.read.schema(f"tracks MAP<STRING, {track}>").json(path, multiLine=True)
    return raw.select(F.explode("tracks").alias("track_id", "t")).select("track_id", "t.*")


def find_class_tables(spark: SparkSession, path: str, override: dict[str, str] | None = None) -> DataFrame:
    """``label, path``: files by name: interior, cockpit, inside or passenger; non and ground; ground alone; an override wins; if no ground file
    is named, it is the largest that is not used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"))
    has = lambda w: F.col("name").contains(w)
    inside = reduce(lambda a, b: a | b, map(has, ("interior", "cockpit", "inside", "passenger")))
    label = F.when(inside, "interior").when(has("non") & has("ground"), "non_ground").when(has("ground") & ~has("non"), "ground")
    named = files.withColumn("label", label)
    first = named.where("label is not null").groupBy("label").agg(F.min_by("path", "name").alias("path"))
    if override:
        first = first.where(~F.col("label").isin(*override)).union(spark.createDataFrame(list(override.items()), "label string, path string"))
    rest = files.join(first.select("path"), "path", "left_anti").agg(F.max_by("path", F.struct("length", "name")).alias("path")).where("path is not null")
    fall = rest.select(F.lit("ground").alias("label"), "path").join(first.select("label"), "label", "left_anti")
    return first.unionByName(fall)


def read_pcd(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Point files of either kind, each read once, as its header says: lines of those that are ASCII, ranges of records of those that are binary. A
    file of another kind, with a damaged header, or without a point has no points but a row with its ``error``.

    Tasks open files by pyarrow's file systems; the driver holds the names of the ASCII files, as Spark does of files that it reads.
    """
    files = written(pcd_files(_listed(spark, path)), "files")
    lines = [r.file for r in files.where("kind = 'ascii' and error is null").select("file").toLocalIterator()]
    binary = _no_error(pcd_records(files)).unionByName(_errors(files))
    return _no_error(read_pcd_ascii(spark, lines)).unionByName(binary) if lines else binary


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pcd": read_pcd, "csv": read_point_csv, "parquet": lambda s, p: s.read.parquet(p), "json": lambda s, p: s.read.json(p)}


def register_reader(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader for files of an extension."""
    _READERS[extension.lower().lstrip(".")] = reader


def read_any(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of any registered kind, by their extension, one after another with all columns."""
    out = []
    for p in paths:
        kind = p.rsplit(".", 1)[-1].lower()
        if kind not in _READERS:
            raise ValueError(f"no reader for .{kind}; there are {', '.join(sorted(_READERS))}")
        out.append(_READERS[kind](spark, p))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def merged_scans(points: DataFrame, file: str, scans: list[int] | None = None, scan: str = "scan_idx") -> DataFrame:
    """Chosen scans of each file as one cloud; finite points only; intensity, and the three colours together, stay only if every chosen scan of the
    file has any."""
    own = points if scans is None else points.where(F.col(scan).isin(scans))
    kinds = {"intensity": ["intensity"], "rgb": ["r", "g", "b"]}
    kinds = {n: cs for n, cs in kinds.items() if set(cs) <= set(points.columns)}
    there = {n: reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cs)) for n, cs in kinds.items()}
    each = own.groupBy(file, scan).agg(F.count("*").alias("__n"), *(F.max(t).alias(f"__{n}") for n, t in there.items()))
    has = each.groupBy(file).agg(F.count("*").alias("__scans"), *(F.min(f"__{n}").alias(f"__{n}") for n in kinds))
    ok = F.lit(True)
    for c in "xyz":
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = {c: F.when(F.col(f"__{n}"), F.col(c)) for n, cs in kinds.items() for c in cs}
    return own.where(ok).join(has, file).withColumns(kept).select(*points.columns)


def pick_topic(topics: DataFrame, bag: str = "bag") -> DataFrame:
    """The first topic of each bag that names a point cloud."""
    hit = topics.where(F.lower("topic").rlike("pointcloud|velodyne_points|points|lidar"))
    return hit.groupBy(bag).agg(F.min_by("topic", "pos").alias("topic"))

