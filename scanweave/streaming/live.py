"""Structured Streaming forms of the time-ordered operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scanweave.operators.filters import in_image
from scanweave.operators.geometry import projected
from scanweave.operators.tracking import MODEL, MODEL_DDL, Models, Tracks, with_coordinates
from scanweave.schema import Params
from scanweave.sources.readers import pcd_files, pcd_records


def frame_stream(spark: SparkSession, path: str, schema: str, delay: str = "2 seconds", max_files: int = 16) -> DataFrame:
    """Rows of Parquet files as they arrive, with ``event_time`` from ``ts`` and a watermark; later rows are dropped by stateful operators."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", delay)


def point_stream(spark: SparkSession, path: str, pattern: str = "*.pcd", seconds: str = r"(\d+(?:\.\d+)?)", delay: str = "2 seconds", max_files: int = 16) -> DataFrame:
    """Points of binary point files as the files arrive: ``file, point_id, x, y, z, intensity, ts, event_time`` with a watermark. ``seconds`` is a
    pattern for the time in a file's name.

    Spark's file source keeps which files are done in the checkpoint and hands on names and lengths, not contents; ranges of records are read by the
    tasks of the batch that a file belongs to, so a large file is many tasks, and nothing is copied. Files without points give none.
    """
    raw = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    listed = raw.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(path).select("path", "length")
    points = pcd_records(pcd_files(listed))
    stamp = F.regexp_extract(F.element_at(F.split("file", "/"), -1), seconds, 1).try_cast("double")
    return points.withColumn("ts", stamp).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", delay)


def windowed_detections(stream: DataFrame, length: str = "5 seconds", slide: str | None = None) -> DataFrame:
    """Detections by window and camera; sliding if a slide is given."""
    return stream.groupBy(F.window("event_time", length, slide), "camera").agg(F.count("*").alias("detections"), F.avg("confidence").alias("confidence"))


def activity_sessions(stream: DataFrame, gap: str = "1 second", device: str = "device_no") -> DataFrame:
    """Stretches of activity of each device."""
    return stream.groupBy(F.session_window("event_time", gap), device).agg(F.count("*").alias("detections"))


def unique_frames(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each frame within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def fused_stream(points: DataFrame, detections: DataFrame, calibration: DataFrame, keys: list[str], within: str = "1 second") -> DataFrame:
    """Points on detection boxes of the same frame, both streams with watermarks; calibration is a static table."""
    shot = projected(points.join(calibration, "device_no")).where((F.col("depth") > 0) & in_image())
    boxes = detections.select(*keys, "camera", "det_id", "x1", "y1", "x2", "y2", F.col("event_time").alias("box_time"))
    near = F.expr(f"box_time >= event_time - INTERVAL {within} AND box_time <= event_time + INTERVAL {within}")
    inside = (F.col("u") >= F.col("x1")) & (F.col("u") <= F.col("x2")) & (F.col("v") >= F.col("y1")) & (F.col("v") <= F.col("y2"))
    return shot.join(boxes, [*keys, "camera"]).where(near & inside)


_WAITING = "ts DOUBLE, camera STRING, det_seq BIGINT, det_id BIGINT, u DOUBLE, v DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE"
_LAST = "ts DOUBLE, camera STRING, u DOUBLE, v DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE"


class _Live(StatefulProcessor):
    """Detections wait until the watermark has passed them and are taken in order of time. Each open track is an entry of its own, which goes once the
    watermark has passed its last detection by the gap."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getMapState("open", "track BIGINT", _LAST)
        self.number = handle.getValueState("number", "next BIGINT")

    def _pass(self, key: tuple, fresh: list[tuple], until: float) -> Iterator[pd.DataFrame]:
        """Take what the watermark has passed, with what has come in; keep the rest, and ask to be woken when the next detection or track is due."""
        waiting = [*(tuple(r) for r in self.waiting.get()), *fresh] if self.waiting.exists() else fresh
        ready = sorted((d for d in waiting if d[0] <= until), key=lambda d: d[:4])
        before = {int(k[0]): tuple(v) for k, v in self.open.iterator()}
        tracks = Tracks(self.params, dict(sorted(before.items())), self.number.get()[0] if self.number.exists() else 0)
        out = [(det, tracks.take((ts, camera, *place))) for ts, camera, _, det, *place in ready]
        tracks.expire(until)
        for k in before.keys() - tracks.last.keys():
            self.open.removeKey((k,))
        for k, t in tracks.last.items():
            if before.get(k) != t:
                self.open.updateValue((k,), t)
        if out:
            self.number.update((tracks.number,))
        late = [d for d in waiting if d[0] > until]
        if late:
            self.waiting.put(late)
        else:
            self.waiting.clear()
        due = [d[0] for d in late] + [t[0] + self.params.track_gap for t in tracks.last.values()]
        if due:
            self.handle.registerTimer(int(min(due) * 1000) + 1)
        yield pd.DataFrame({"device_no": key[0], "sequence_no": key[1], "det_id": [d for d, _ in out], "track_id": [t for _, t in out]}, columns=["device_no", "sequence_no", "det_id", "track_id"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["ts", "camera", "det_seq", "det_id", "u", "v", "cx", "cy", "cz"]
        fresh = [tuple(r) for b in rows for r in zip(*(b[c].tolist() for c in names), strict=True)]
        yield from self._pass(key, fresh, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._pass(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def tracker_stream(detections: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """``device_no, sequence_no, det_id, track_id`` of a stream of detections, each emitted once the watermark has passed it.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider. Tracks of one detection are reported, too.
    """
    own = detections.select(
        "device_no", "sequence_no", "event_time", "ts", "camera", F.col("det_seq").cast("long").alias("det_seq"), "det_id", ((F.col("x1") + F.col("x2")) / 2).alias("u"), ((F.col("y1") + F.col("y2")) / 2).alias("v"), "cx", "cy", "cz"
    )
    return own.groupBy("device_no", "sequence_no").transformWithStateInPandas(
        _Live(params), outputStructType="device_no BIGINT, sequence_no BIGINT, det_id BIGINT, track_id BIGINT", outputMode="Append", timeMode="EventTime"
    )


_WAITING_POINTS = "ts DOUBLE, camera STRING, det_seq BIGINT, det_id BIGINT, px ARRAY<DOUBLE>, py ARRAY<DOUBLE>, pz ARRAY<DOUBLE>"
_HEAD = "seen DOUBLE, times BIGINT, n BIGINT, total ARRAY<DOUBLE>, least ARRAY<DOUBLE>, most ARRAY<DOUBLE>, cells ARRAY<BIGINT>"


class _StateCells:
    """Points of tracks in map state by (track, cell). A pass reads the cells that it is asked for, and writes back those that it has changed."""

    def __init__(self, state):  # noqa: ANN001
        self.state, self.read, self.changed, self.fresh = state, {}, set(), {}

    def get(self, key: tuple) -> list[float] | None:
        if key not in self.read:
            self.read[key] = [float(v) for v in self.state.getValue(key)[0]] if self.state.containsKey(key) else None
        return self.read[key]

    def __setitem__(self, key: tuple, points: list[float]) -> None:
        if self.get(key) is None:
            self.fresh.setdefault(key[0], []).append(key[1:])
        self.read[key] = points
        self.changed.add(key)

    def forget(self, track: int) -> None:
        """Its cells go with its head, which lists them."""
        self.fresh.pop(track, None)
        for key in [key for key in self.read if key[0] == track]:
            del self.read[key]
            self.changed.discard(key)

    def write(self) -> None:
        for key in self.changed:
            self.state.updateValue(key, (self.read[key],))


class _LiveModels(StatefulProcessor):
    """The accumulating tracker: detections wait, with their points, until the watermark has passed them; a track's head and each cell of its points are
    entries of their own, and all of them go once the watermark has passed its last detection by the gap."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING_POINTS)
        self.heads = handle.getMapState("heads", "track BIGINT", _HEAD)
        self.cells = handle.getMapState("cells", "track BIGINT, i BIGINT, j BIGINT, k BIGINT", "points ARRAY<DOUBLE>")
        self.call = handle.getValueState("call", "next BIGINT, ts DOUBLE, camera STRING, below BIGINT")

    def _pass(self, key: tuple, fresh: list[tuple], until: float) -> Iterator[pd.DataFrame]:
        waiting = [*(tuple(r) for r in self.waiting.get()), *fresh] if self.waiting.exists() else fresh
        ready = sorted((d for d in waiting if d[0] <= until), key=lambda d: d[:4])
        known = {int(k[0]): tuple(v) for k, v in self.heads.iterator()}
        plain = lambda m: (m[0], int(m[1]), int(m[2]), *([float(x) for x in c] for c in m[3:6]))
        number, ts, camera, below = self.call.get() if self.call.exists() else (0, None, None, 0)
        cells = _StateCells(self.cells)
        heads = {k: plain(known[k]) for k in sorted(known)}
        models = Models(self.params, cells, heads, int(number), None if ts is None else (ts, camera), int(below))
        out = [models.take(det, at, cam, *points) for at, cam, _, det, *points in ready]
        models.expire(until)
        cells.write()
        for k in known.keys() - models.open.keys():
            listed = [int(v) for v in known[k][6]]
            for at in range(0, len(listed), 3):
                self.cells.removeKey((k, *listed[at : at + 3]))
            self.heads.removeKey((k,))
        for k, m in models.open.items():
            if k not in known or plain(known[k]) != m:
                before = [int(v) for v in known[k][6]] if k in known else []
                self.heads.updateValue((k,), (*m, [*before, *(v for c in cells.fresh.get(k, ()) for v in c)]))
        if out:
            self.call.update((models.number, *models.call, models.limit))
        late = [d for d in waiting if d[0] > until]
        if late:
            self.waiting.put(late)
        else:
            self.waiting.clear()
        due = [d[0] for d in late] + [m[0] + self.params.model_gap for m in models.open.values()]
        if due:
            self.handle.registerTimer(int(min(due) * 1000) + 1)
        names = ["det_id", "track_id", "det_ordinal", "n_new", "n_points", *MODEL]
        yield pd.DataFrame({"device_no": key[0], "sequence_no": key[1], **dict(zip(names, zip(*out, strict=True), strict=True))} if out else {}, columns=["device_no", "sequence_no", *names])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        plain = lambda v: [float(x) for x in v]
        fresh = [(r.ts, r.camera, int(r.det_seq), int(r.det_id), plain(r.px), plain(r.py), plain(r.pz)) for b in rows for r in b.itertuples()]
        yield from self._pass(key, fresh, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._pass(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def model_stream(detections: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The rows of the accumulating tracker (M10) for a stream of detections with ``points``, each emitted once the watermark has passed it.

    A detection reads the cells of a track that its points touch, not the track. Detections without points are left out; tracks of one detection are
    reported, too. Needs the RocksDB state store, as ``tracker_stream``.
    """
    own = with_coordinates(detections).select("device_no", "sequence_no", "event_time", "ts", "camera", F.col("det_seq").cast("long").alias("det_seq"), "det_id", "px", "py", "pz")
    return own.groupBy("device_no", "sequence_no").transformWithStateInPandas(_LiveModels(params), outputStructType=f"device_no BIGINT, sequence_no BIGINT, {MODEL_DDL}", outputMode="Append", timeMode="EventTime")
