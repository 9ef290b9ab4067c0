"""Tracks over detection sequences: the basic and the accumulating tracker, and what follows from tracks.

Association depends on the order of detections. So rows are sorted inside partitions by stretch (basic) or sequence (accumulating) and time, and read
as a stream: a group is never held as a whole, and of a tracker only its open tracks are, those that a later detection may still join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanweave.functions.scratch import written
from scanweave.schema import Params

from .neighbors import merged


def in_order(rows: DataFrame, group: list[str], order: list[str], columns: list[str], schema: str, start: Callable[[], Callable[[tuple], tuple]]) -> DataFrame:
    """``group`` and what a function that ``start`` makes for each group returns of each row's ``columns``, row by row in ``order``."""
    made = T.StructType([*(rows.schema[k] for k in group), *T.StructType.fromDDL(schema)])
    out = to_arrow_schema(made)
    placed = rows.select(*group, *columns).repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, take = None, None
        for b in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = r[: len(group)]
                if take is None or key != now:
                    now, take = key, start()
                found.append((*key, *take(r[len(group) :])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return placed.mapInArrow(run, made)


def gap_segments(detections: DataFrame, keys: list[str], gap: float = 1.0) -> DataFrame:
    """``segment_id``: counts the gaps in time so far, over all cameras of a sequence."""
    order = Window.partitionBy(*keys).orderBy("ts", "camera", "det_seq", "det_id")
    broken = F.when(F.col("ts") - F.lag("ts").over(order) > gap, 1).otherwise(0)
    return detections.withColumn("__b", broken).withColumn("segment_id", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


class Tracks:
    """The open tracks of one stretch by number, each with the last detection it took; detections come in order of time, so stale tracks go."""

    def __init__(self, p: Params, last: dict[int, tuple] | None = None, number: int = 0):
        self.p, self.last, self.number = p, last or {}, number

    def score(self, a: tuple, b: tuple) -> float:
        """Distance of box centres plus ten times that of centres in space; out of reach if those are too far apart."""
        flat = math.hypot(a[2] - b[2], a[3] - b[3])
        if any(v is None or math.isnan(v) for v in (*a[4:7], *b[4:7])):
            return flat
        space = math.dist(a[4:7], b[4:7])
        return math.inf if space > self.p.track_distance else flat + 10 * space

    def expire(self, ts: float) -> None:
        if any(ts - t[0] > self.p.track_gap for t in self.last.values()):
            self.last = {k: t for k, t in self.last.items() if ts - t[0] <= self.p.track_gap}

    def take(self, d: tuple) -> int:
        """The track of a detection ``ts, camera, u, v, cx, cy, cz``."""
        self.expire(d[0])
        best, low = None, self.p.track_score
        for k, t in self.last.items():
            if t[1] == d[1]:
                s = self.score(t, d)
                if s < low:
                    best, low = k, s
        if best is None:
            best = self.number
            self.number += 1
        self.last[best] = d
        return best


def basic_tracks(detections: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """M9: ``track_id`` (by key: in the order of stretches, then of tracks) of each detection in a track of two or more."""
    cut = gap_segments(detections, keys, p.track_gap)
    own = cut.withColumns({"__u": (F.col("x1") + F.col("x2")) / 2, "__v": (F.col("y1") + F.col("y2")) / 2})
    group = [*keys, "segment_id"]

    def start() -> Callable[[tuple], tuple]:
        tracks = Tracks(p)
        return lambda r: (r[0], tracks.take(r[1:8]))

    found = in_order(own, group, ["ts", "camera", "det_seq", "det_id"], ["det_id", "ts", "camera", "__u", "__v", "cx", "cy", "cz", "det_seq"], "det_id BIGINT, local BIGINT", start)
    kept = found.groupBy(*group, "local").agg(F.count("*").alias("n")).where("n >= 2")
    number = kept.withColumn("track_id", F.row_number().over(Window.partitionBy(*keys).orderBy("segment_id", "local")) - 1).drop("n")
    return detections.join(merged(found.join(merged(number), [*group, "local"]).select(*keys, "det_id", "track_id")), [*keys, "det_id"])


def near_median(points: np.ndarray, sigmas: float = 2.0) -> np.ndarray:
    """M5b of one detection: points whose distance from its median is at most the mean such distance plus so many deviations."""
    n = len(points)
    if n < 3:
        return points
    order = np.sort(points, axis=0)
    away = points - (order[(n - 1) // 2] + order[n // 2]) / 2
    far = np.sqrt((away * away).sum(1))
    return points[far <= far.mean() + sigmas * far.std()]


#: Steps to a cell and those around it.
_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


class Models:
    """The open tracks of a sequence, each with a few figures of the points that it has accumulated, and the points themselves by cells.

    ``cells`` maps (track, i, j, k) to the points of a cell, three numbers each in a row. A detection reads the cells that its points touch and no others,
    so its work does not grow with the track. Any mapping with ``get``, item assignment and ``forget(track)`` will do, a stream's state among them.
    """

    def __init__(self, p: Params, cells=None, heads: dict[int, tuple] | None = None, number: int = 0, call: tuple | None = None, limit: int = 0):  # noqa: ANN001
        self.p, self.cells, self.number = p, Cells() if cells is None else cells, number
        #: By number: when last seen, detections, points, their sums, least and greatest coordinates.
        self.open: dict[int, tuple[float, int, int, list[float], list[float], list[float]]] = heads or {}
        #: The frame and camera that detections come from now; only tracks with lower numbers than ``limit`` were there before it.
        self.call, self.limit = call, limit

    def expire(self, ts: float) -> None:
        for k in [k for k, m in self.open.items() if ts - m[0] > self.p.model_gap]:
            del self.open[k]
            self.cells.forget(k)

    def merged(self, track: int, new: np.ndarray) -> np.ndarray:
        """Of new points those farther than the distance from all that the track has; new points are not compared with each other."""
        d, get = self.p.merge_distance, self.cells.get
        keep = []
        for (x, y, z), (i, j, k) in zip(new.tolist(), np.floor(new / d).astype(np.int64).tolist(), strict=True):
            near = False
            for a, b, c in _AROUND:
                q = get((track, i + a, j + b, k + c))
                if q is not None and any((q[m] - x) ** 2 + (q[m + 1] - y) ** 2 + (q[m + 2] - z) ** 2 <= d * d for m in range(0, len(q), 3)):
                    near = True
                    break
            keep.append(not near)
        return new[np.array(keep, bool)]

    def add(self, track: int, new: np.ndarray) -> None:
        for p, (i, j, k) in zip(new.tolist(), np.floor(new / self.p.merge_distance).astype(np.int64).tolist(), strict=True):
            self.cells[track, i, j, k] = [*(self.cells.get((track, i, j, k)) or ()), *p]

    def take(self, det_id: int, ts: float, camera: str, x: list[float], y: list[float], z: list[float]) -> tuple:
        if (ts, camera) != self.call:  # a frame and camera: only tracks open before it can be joined
            self.call, self.limit = (ts, camera), self.number
            self.expire(ts)
        pts = np.array((x, y, z), float).T
        mid, best, low = pts.mean(0).tolist(), None, math.inf
        for k, (seen, _, n, total, _, _) in self.open.items():
            if k < self.limit:
                far = math.dist([t / n for t in total], mid)
                if far <= self.p.model_distance and far + 0.1 * (ts - seen) < low:
                    best, low = k, far + 0.1 * (ts - seen)
        new = near_median(pts)
        if best is None:
            best, times, n, total, least, most = self.number, 0, 0, [0.0] * 3, [math.inf] * 3, [-math.inf] * 3
            self.number += 1
        else:
            _, times, n, total, least, most = self.open[best]
            new = self.merged(best, new)
        if len(new):
            self.add(best, new)
            total = [a + b for a, b in zip(total, new.sum(0).tolist(), strict=True)]
            least, most = [*map(min, least, new.min(0).tolist())], [*map(max, most, new.max(0).tolist())]
        n += len(new)
        self.open[best] = (ts, times + 1, n, total, least, most)
        return det_id, best, times + 1, len(new), n, *(t / n for t in total), *least, *most


class Cells(dict):
    """Points by (track, i, j, k) in memory."""

    def __init__(self):
        super().__init__()
        self.of: dict[int, list[tuple]] = {}

    def __setitem__(self, key: tuple, points: list[float]) -> None:
        if key not in self:
            self.of.setdefault(key[0], []).append(key)
        super().__setitem__(key, points)

    def forget(self, track: int) -> None:
        for key in self.of.pop(track, ()):
            del self[key]


MODEL = [f"{n}_{a}" for n in ("centre", "lo", "hi") for a in "xyz"]
MODEL_DDL = "det_id BIGINT, track_id BIGINT, det_ordinal BIGINT, n_new BIGINT, n_points BIGINT, " + ", ".join(f"{c} DOUBLE" for c in MODEL)


def with_coordinates(detections: DataFrame) -> DataFrame:
    """Detections that have points, whose coordinates as three arrays ``px, py, pz``."""
    own = detections.where(F.size("points") > 0)
    return own.withColumns({f"p{a}": F.transform("points", lambda q: q[a].cast("double")) for a in "xyz"})  # noqa: B023


def accumulating_tracks(detections: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """For detections with ``points`` (an array of x, y, z structs) ``keys, det_id, track_id`` and of the track then ``det_ordinal``, the points this
    detection added ``n_new``, all of them ``n_points``, their centre and bounds.

    A detection goes to the track open before its frame and camera whose centre is nearest to the mean of its points (plus a tenth of a metre for each
    second), if not too far or too old. Of its points those near its median (M5b) are added that the track doesn't have (J5). Tracks of two detections
    and more are kept.

    After a pause longer than the gap no track is open. So a sequence is cut there into stretches, which are tracked apart and whose tracks are then
    numbered on; a task holds the points of one stretch's open tracks.
    """
    own = with_coordinates(gap_segments(detections.where(F.size("points") > 0), keys, p.model_gap)).withColumnRenamed("segment_id", "__stretch")

    def start() -> Callable[[tuple], tuple]:
        models = Models(p)
        return lambda r: models.take(*r[:6])

    stretch = [*keys, "__stretch"]
    made = in_order(own, stretch, ["ts", "camera", "det_seq", "det_id"], ["det_id", "ts", "camera", "px", "py", "pz", "det_seq"], MODEL_DDL, start)
    made = written(made, "accumulated")
    opened = made.groupBy(*stretch).agg((F.max("track_id") + 1).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = made.groupBy(*stretch, "track_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= 2).select(*stretch, "track_id")
    first = opened.select(*stretch, before.alias("__first"))
    return made.join(merged(kept.join(merged(first), stretch)), [*stretch, "track_id"]).withColumn("track_id", F.col("track_id") + F.col("__first")).drop("__stretch", "__first")


def model_summary(accumulated: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Of each track of ``accumulating_tracks`` its detections, accumulated points, centre, size, duration, cameras, and quality
    min(1, points / 100 * detections / 5)."""
    last = F.max_by(F.struct("n_points", *MODEL), "det_ordinal").alias("m")
    when = accumulated.join(merged(detections.select(*keys, "det_id", "ts", "camera")), [*keys, "det_id"])
    got = when.groupBy(*keys, "track_id").agg(
        F.count("*").alias("n_detections"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"), last
    )
    got = got.select(*keys, "track_id", "n_detections", "start", "end", "cameras", "m.*").withColumn("duration", F.col("end") - F.col("start"))
    size = {f"size_{a}": F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"}
    return got.withColumns(size | {"quality": F.least(F.lit(1.0), F.col("n_points") / 100.0 * F.col("n_detections") / 5.0)})


def track_analysis(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Of all tracks of each key (or of all, without keys): how many, mean duration, mean detections, and the cameras that see any."""
    cameras = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("cameras", ","))))), ",")
    return tracks.groupBy(*keys).agg(F.count("*").alias("tracks"), F.avg("duration").alias("mean_duration"), F.avg("n_detections").alias("mean_detections"), cameras.alias("cameras"))


def tracks_by_camera(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks that each camera sees; a track of two cameras counts for both."""
    return tracks.withColumn("camera", F.explode(F.split("cameras", ","))).groupBy(*keys, "camera").agg(F.count("*").alias("tracks"))


def track_summary(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Of each track its detections, points, duration, cameras, mean and extent of its detections' centres, and quality min(1, points / 100 *
    detections / 5)."""
    got = tracked.groupBy(*keys, "track_id").agg(
        F.count("*").alias("n_detections"), F.sum("n_points").alias("n_points"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.array_join(F.sort_array(F.collect_set("camera")), ",").alias("cameras"), F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.avg("cz").alias("mz"),
        *((F.max(c) - F.min(c)).alias(f"size_{c[1]}") for c in ("cx", "cy", "cz")),
    )
    quality = F.least(F.lit(1.0), F.col("n_points") / 100.0 * F.col("n_detections") / 5.0)
    return got.withColumns({"duration": F.col("end") - F.col("start"), "quality": quality})


def fleet(tracks: DataFrame) -> DataFrame:
    """A32."""
    return tracks.agg(F.count("*").alias("cars"), F.sum("n_detections").alias("detections"), F.sum("n_points").alias("points"), F.avg("quality").alias("mean_quality"))


def trajectories(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Displacement, speed and time since the track's start at each detection."""
    order = Window.partitionBy(*keys, "track_id").orderBy("ts", "det_id")
    back = lambda c: F.col(c) - F.lag(c).over(order)
    step = F.sqrt(back("cx") * back("cx") + back("cy") * back("cy") + back("cz") * back("cz"))
    out = tracked.withColumns({"step": step, "dt": back("ts"), "since": F.col("ts") - F.min("ts").over(Window.partitionBy(*keys, "track_id"))})
    return out.withColumn("speed", F.try_divide("step", "dt"))


def accumulation(tracked: DataFrame, keys: list[str]) -> DataFrame:
    """After each detection: its number, cumulative points, bounds, density, quality, completeness and best confidence so far."""
    order = Window.partitionBy(*keys, "track_id").orderBy("ts", "det_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = tracked.withColumns(
        {"det_ordinal": F.row_number().over(order), "cumulative": F.sum("n_points").over(so_far), "best_confidence": F.max("confidence").over(so_far)}
        | {f"{c}_{n}": f(c).over(so_far) for c in ("cx", "cy", "cz") for n, f in (("lo", F.min), ("hi", F.max))}
        | {"total": F.sum("n_points").over(Window.partitionBy(*keys, "track_id"))}
    )
    volume = F.lit(1.0)
    for c in ("cx", "cy", "cz"):
        side = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        volume = volume * F.when(side > 0, side).otherwise(1.0)
    return out.withColumns(
        {"density": F.col("cumulative") / F.greatest(F.lit(1.0), volume), "quality": F.least(F.lit(1.0), F.col("cumulative") / 100.0), "completeness": 100 * F.try_divide(F.col("cumulative").cast("double"), F.col("total").cast("double"))}
    )


def with_age(points: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Age scaled to 0..1 in each track, and its colour from blue to red."""
    whole = Window.partitionBy(*keys)
    age = (F.col(ts) - F.min(ts).over(whole)) / (F.max(ts).over(whole) - F.min(ts).over(whole) + 1e-6)
    return points.withColumn("age", age).withColumns({"red": F.col("age"), "green": F.lit(0.0), "blue": 1 - F.col("age")})


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in the plane, by the monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    def half(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]
    return np.array(half(p) + half(p[::-1]))


def _hulls(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group in a batch of rows the corners of its hull, so a group of any size is a few corners for each batch."""
    made = T.StructType([*(rows.schema[k] for k in keys), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [pd.DataFrame(h, columns=["x", "y"]).assign(**dict(zip(keys, key, strict=True))) for key, g in b.groupby(keys, sort=False, dropna=False) for h in [_hull(g[["x", "y"]].to_numpy())]]
            if parts:
                yield pd.concat(parts)[[*keys, "x", "y"]]

    return rows.select(*keys, "x", "y").mapInPandas(run, made)


def footprints(points: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """Corners and area of the footprint of each group of at least ``least`` points: hulls of batches first, then the hull of their corners."""
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    few = _hulls(_hulls(points, keys).repartition(*keys), keys)
    whole = T.StructType([*(points.schema[k] for k in keys), T.StructField("corners", T.LongType()), T.StructField("area", T.DoubleType())])

    def all_(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = _hull(rows[["x", "y"]].to_numpy())
        area = abs(float(np.sum(h[:, 0] * np.roll(h[:, 1], -1) - h[:, 1] * np.roll(h[:, 0], -1)))) / 2 if len(h) > 2 else 0.0
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "corners": [len(h)], "area": [area]})

    return few.groupBy(*keys).applyInPandas(all_, whole).join(n.where(F.col("n") >= least), keys)
