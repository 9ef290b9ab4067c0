"""Streams end with what batches give; late rows are dropped."""

import os

from pyspark.sql import functions as F

from scanweave.operators import tracking as tr
from scanweave.plans import fixtures as fx
from scanweave.streaming import live


def run(query_df, name, tmp_path, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return query_df.sparkSession.table(name)


def detections(spark, sf, tmp_path, files=4):
    d = fx.detections(spark, sf).where("sequence_no < 2").withColumn("ts", F.col("ts") - F.col("sequence_no") * 1000 + 100)
    closing = d.limit(1).withColumns({"ts": F.lit(10000.0), "det_id": F.lit(-1).cast("long"), "sequence_no": F.lit(99).cast("long")})
    for k in range(files):
        d.where((F.col("ts") >= 100 + 3 * k) & (F.col("ts") < 103 + 3 * k)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    closing.coalesce(1).write.parquet(str(tmp_path / "in" / "q"))
    return d, d.schema.simpleString()[7:-1].replace(":", " ")


def schema_of(d):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema)


def test_windows_sessions_and_duplicates(spark, sf, tmp_path):
    d, _ = detections(spark, sf, tmp_path)
    s = live.frame_stream(spark, str(tmp_path / "in" / "*"), schema_of(d), max_files=1)
    w = run(live.windowed_detections(s), "w", tmp_path)
    assert w.where("window.start < '1970-01-01 00:30:00'").agg(F.sum("detections")).first()[0] == d.count()
    x = run(live.activity_sessions(s), "x", tmp_path)
    assert x.where("session_window.start < '1970-01-01 00:30:00'").count() == 2 * d.select("device_no").distinct().count()
    u = run(live.unique_frames(s, ["sequence_no", "frame_id"]), "u", tmp_path)
    assert u.where("sequence_no < 2").count() == 80


def test_tracker_stream_is_the_batch_tracker(spark, sf, tmp_path):
    d, _ = detections(spark, sf, tmp_path)
    s = live.frame_stream(spark, str(tmp_path / "in" / "*"), schema_of(d), max_files=1)
    got = run(live.tracker_stream(s), "t", tmp_path).where("sequence_no < 2").collect()
    want = tr.basic_tracks(d, fx.TRACK_KEYS).collect()
    groups = lambda rows: {frozenset(r.det_id for r in rows if (r.sequence_no, r.track_id) == k) for k in {(r.sequence_no, r.track_id) for r in rows}}
    assert len(got) == d.count() and groups(got) == groups(want)


def test_fused_stream_is_the_batch_join(spark, sf, tmp_path):
    from scanweave.operators import fusion as fu
    from scanweave.plans import tracking as tq

    at = (F.col("scan_idx") + 100).cast("double")
    p = fx.points(spark, sf).withColumn("ts", at)
    d = tq._boxes_in_view(spark, sf).withColumn("ts", at)
    for name, df in (("p", p), ("d", d)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    cal = spark.sql(fx.CALIBRATION)
    s = live.fused_stream(live.frame_stream(spark, str(tmp_path / "p"), schema_of(p)), live.frame_stream(spark, str(tmp_path / "d"), schema_of(d)), cal, tq.FRAME)
    got = run(s.select("point_id", "det_id"), "f", tmp_path)
    want = fu.attached(tq._shot(spark, sf), d, tq.FRAME).select("point_id", "det_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def with_points(d):
    x = lambda k: F.col("cx") + k * 0.1
    return d.withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(x(k).alias("x"), F.col("cy").alias("y"), (F.col("cz") + (k % 2) * 0.2).alias("z"))))


def test_model_stream_is_the_batch_tracker(spark, sf, tmp_path):
    """Files in order of time, with a row that comes too late and a pause in which all tracks go."""
    d = with_points(fx.detections(spark, sf).where("sequence_no < 2").withColumn("ts", F.col("ts") - F.col("sequence_no") * 1000 + 100))
    late = d.where("det_id = 0").withColumns({"ts": F.lit(100.0), "det_id": F.lit(-7).cast("long")})
    closing = d.limit(1).withColumns({"ts": F.lit(10000.0), "det_id": F.lit(-1).cast("long"), "sequence_no": F.lit(99).cast("long")})
    for k in range(4):
        d.where((F.col("ts") >= 100 + 3 * k) & (F.col("ts") < 103 + 3 * k)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "p4"))
    closing.coalesce(1).write.parquet(str(tmp_path / "in" / "q"))
    s = live.frame_stream(spark, str(tmp_path / "in" / "*"), schema_of(d), max_files=1)
    got = [r for r in run(live.model_stream(s), "models", tmp_path).where("sequence_no < 2").collect()]
    want = {(r.sequence_no, r.det_id): r.asDict() for r in tr.accumulating_tracks(d, fx.TRACK_KEYS).collect()}
    assert len(got) == d.count() and all(r.det_id >= 0 for r in got)
    several = {k for k in {(r.sequence_no, r.track_id) for r in got} if sum((r.sequence_no, r.track_id) == k for r in got) > 1}
    kept = {(r.sequence_no, r.det_id): r.asDict() for r in got if (r.sequence_no, r.track_id) in several}
    assert kept.keys() == want.keys() and len({r["track_id"] for r in want.values()}) > 3 and any(r["n_new"] < 6 for r in want.values())
    for k, r in want.items():
        assert all(abs(r[c] - kept[k][c]) < 1e-9 for c in r)


def test_point_files_as_they_arrive(spark, tmp_path):
    import struct

    (tmp_path / "in").mkdir()
    for k in range(6):
        body = b"".join(struct.pack("<3f", k, j, 0) for j in range(10 + k))
        (tmp_path / "in" / f"scan_{100 + k}.pcd").write_bytes(f"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS {10 + k}\nDATA binary\n".encode() + body)
    (tmp_path / "in" / "scan_200.pcd").write_bytes(b"damaged")
    (tmp_path / "in" / "scan_900.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 1\nDATA binary\n" + struct.pack("<3f", 9, 9, 9))
    for k, f in enumerate(sorted((tmp_path / "in").iterdir())):  # files come in order of their times
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    s = live.point_stream(spark, str(tmp_path / "in"), max_files=2)
    got = run(s, "files", tmp_path)
    assert sorted((r.x, r.point_id) for r in got.collect()) == sorted([(float(k), j) for k in range(6) for j in range(10 + k)] + [(9.0, 0)])
    w = run(s.groupBy(F.window("event_time", "2 seconds")).agg(F.count("*").alias("n")), "windows", tmp_path)
    assert [r.n for r in w.orderBy("window").collect()] == [21, 25, 29]
