"""Files written and read back, damaged lines included."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from scanweave.operators import fusion as fu
from scanweave.operators import tracking as tr
from scanweave.plans import fixtures as fx
from scanweave.plans import tracking
from scanweave.sources import readers as rd
from scanweave.sources import sinks as sk


def test_pcd_ascii(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("# x\nFIELDS x y z\nDATA ascii\n1 2 3 4.5\n1 2\n# no\nbad 1 2\n4 5 6\n")
    rows = rd.read_pcd_ascii(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.intensity) for r in rows] == [(1, 2, 3, 4.5), (4, 5, 6, None)]
    assert rd.read_pcd_ascii(spark, str(tmp_path), fill_intensity=0.0).where("intensity = 0").count() == 1
    assert rd.read_pcd_ascii(spark, str(tmp_path), rejects=True).count() == 3


def test_large_files_are_numbered_by_blocks(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("FIELDS x y z\nDATA ascii\n" + "".join(f"{k} 0 0\n" for k in range(5000)))
    (tmp_path / "b.pcd").write_text("DATA ascii\n7 0 0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        df = rd.read_pcd_ascii(spark, str(tmp_path))
        rows = df.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.point_id, r.x) for r in rows if r.file.endswith("a.pcd")) == [(k + 2, float(k)) for k in range(5000)]
    assert [(r.point_id, r.x) for r in rows if r.file.endswith("b.pcd")] == [(1, 7.0)]


def test_pcd_of_either_kind(spark, tmp_path):
    (tmp_path / "a.pcd").write_text("FIELDS x y z\nDATA ascii\n1 2 3\n")
    (tmp_path / "b.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 2\nDATA binary\n" + struct.pack("<6f", 4, 5, 6, 7, 8, 9))
    (tmp_path / "c.pcd").write_bytes(b"FIELDS x\nDATA binary_compressed\n\0\0")
    rows = rd.read_any(spark, [str(tmp_path / f"{n}.pcd") for n in "abc"]).collect()
    assert sorted((r.x, r.y, r.z) for r in rows if r.error is None) == [(1, 2, 3), (4, 5, 6), (7, 8, 9)] and [r.error for r in rows if r.error] == ["not ascii or binary: binary_compressed"]


def test_pcd_binary(spark, tmp_path):
    head = "FIELDS x y z ring extra\nSIZE 4 4 8 2 4\nTYPE F F F U F\nCOUNT 1 1 1 1 2\nPOINTS 3\nDATA binary\n"
    body = b"".join(struct.pack("<ffdHff", k, 2 * k, 3 * k, k, 0, 0) for k in (1, 2, 3))
    (tmp_path / "b.pcd").write_bytes(head.encode() + body[:-5])
    (tmp_path / "c.pcd").write_text("FIELDS x\nDATA ascii\n1\n")
    rows = rd.read_pcd_binary(spark, str(tmp_path)).collect()
    assert sorted((r.x, r.y, r.z) for r in rows if r.error is None) == [(1, 2, 3), (2, 4, 6)]
    assert [r.error for r in rows if r.error] == ["not binary: ascii"]


def test_large_binary_files_are_ranges(spark, tmp_path):
    (tmp_path / "b.pcd").write_bytes(b"FIELDS x y z intensity\nSIZE 8 4 4 4\nTYPE F F F F\nDATA binary\n" + b"".join(struct.pack("<dfff", k, 2, 3, k % 7) for k in range(5000)) + b"cut")
    df = rd.read_pcd_binary(spark, str(tmp_path), records=300)
    assert sorted((r.point_id, r.x, r.intensity) for r in df.collect()) == [(k, float(k), k % 7) for k in range(5000)]
    assert df.where("error is null").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_files_that_hold_no_points_are_error_rows(spark, tmp_path):
    """Damaged headers, other kinds, and files without a valid point; the others are read."""
    bad = {
        "a.pcd": b"\xff\xfe" * 13, "b.pcd": b"FIELDS x y z\nDATA ascii\n# no\nbad 1 2\n1 2\n", "c.pcd": b"FIELDS x y z\nSIZE 4 4\nTYPE F F F\nDATA binary\n" + b"0" * 24,
        "d.pcd": b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 9\nDATA binary\n" + b"0" * 11, "e.pcd": b"FIELDS x y z\nSIZE 3 4 4\nTYPE F F F\nDATA binary\n" + b"0" * 24, "g.pcd": b"FIELDS x\nDATA\n", "h.pcd": b"DATA ascii\n",
    }
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x.pcd").write_bytes(b"FIELDS x y z\nDATA ascii\n" + b"# none here\n" * 9000 + b"1 2 3")
    (tmp_path / "y.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nDATA binary\n" + struct.pack("<3f", 4, 5, 6))
    rows = rd.read_pcd(spark, str(tmp_path)).collect()
    assert sorted((r.x, r.y, r.z) for r in rows if r.error is None) == [(1, 2, 3), (4, 5, 6)]
    errors = {r.file.rsplit("/", 1)[-1]: r.error for r in rows if r.error}
    assert errors.keys() == bad.keys() and errors["b.pcd"] == errors["d.pcd"] == errors["h.pcd"] == "no points" and errors["a.pcd"].startswith("damaged")


def test_exporters_by_registration(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    places = sk.export({"one": df, "two": df}, str(tmp_path / "out"), "json")
    assert spark.read.json(places["two"]).first().name == "a" and set(places) == {"one", "two"}
    sk.register_writer(".orc", lambda rows, path: rows.write.orc(path))
    assert "orc" in sk.formats() and spark.read.orc(sk.export({"one": df}, str(tmp_path / "more"), "orc")["one"]).count() == 1
    with pytest.raises(ValueError, match="there are csv, json"):
        sk.export({"one": df}, str(tmp_path), "zzz")


def test_point_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("point.x,point.y,point.z,i,r,g\n1,2,3,9,1,1\n")
    r = rd.read_point_csv(spark, str(tmp_path / "p.csv")).first()
    assert (r.x, r.z, r.intensity, r.r) == (1, 3, 9, None)
    (tmp_path / "n.csv").write_text("x,y,z\n" + "".join(f"{k},0,0\n" for k in range(9)))
    assert sorted((r.point_id, r.x) for r in rd.read_point_csv(spark, str(tmp_path / "n.csv")).collect()) == [(k, float(k)) for k in range(9)]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        rd.read_point_csv(spark, str(tmp_path / "q.csv"))


def test_catalogue_and_calibration(spark, tmp_path):
    cam = {"file_path": "i.png", "filename": "i.png", "timestamp": 1.5}
    frame = {"frame_id": 1, "device_id": "d_1", "sequence_id": "s", "reference_timestamp": 1.25, "lidar": cam, "cam0": cam, "synchronization": {"sync_quality": "good"}}
    (tmp_path / "f.json").write_text(json.dumps({"correspondence_frames": [frame, {"frame_id": 2, "device_id": "d_1", "cam0": cam, "cam1": cam}]}))
    rows = rd.read_catalogue(spark, str(tmp_path / "f.json")).orderBy("frame_id", "camera").collect()
    assert [(r.frame_id, r.camera) for r in rows] == [(1, "cam0"), (2, "cam0"), (2, "cam1")] and rows[0].event_time.microsecond == 250000
    k, e = [[1, 0, 2], [0, 3, 4], [0, 0, 1]], [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]
    (tmp_path / "cal").mkdir()
    (tmp_path / "cal" / "dev_7.json").write_text(json.dumps({"cam_1": {"intrinsic": k, "extrinsic": e}}))
    (r,) = rd.read_calibration(spark, str(tmp_path / "cal")).collect()
    assert (r.device_id, r.camera, r.fx, r.fy, r.cx0, r.t3) == ("dev_7", "cam1", 1, 3, 2, 7)


def test_class_tables_and_topics(spark, tmp_path):
    for n, size in (("Cockpit_a.bin", 1), ("non_ground.bin", 2), ("other.bin", 9)):
        (tmp_path / n).write_bytes(b"x" * size)
    got = {r.label: r.path.rsplit("/", 1)[-1] for r in rd.find_class_tables(spark, str(tmp_path)).collect()}
    assert got == {"interior": "Cockpit_a.bin", "non_ground": "non_ground.bin", "ground": "other.bin"}
    topics = spark.createDataFrame([("b", 0, "/imu"), ("b", 1, "/Lidar/top"), ("b", 2, "/points")], "bag string, pos int, topic string")
    assert rd.pick_topic(topics).first().topic == "/Lidar/top"


def test_routing_merging_and_missing(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(3)], "id long").write.parquet(str(tmp_path / "a.parquet"))
    assert rd.read_any(spark, [str(tmp_path / "a.parquet")]).count() == 3
    with pytest.raises(ValueError):
        rd.read_any(spark, ["x.zzz"])
    p = spark.createDataFrame([("f", 0, 1.0, 1.0, 1.0, 1.0), ("f", 1, 1.0, float("nan"), 1.0, None), ("f", 1, 2.0, 2.0, 2.0, None)], "file string, scan_idx int, x double, y double, z double, intensity double")
    assert rd.merged_scans(p, "file").where("intensity is null").count() == 2 and rd.merged_scans(p, "file", [0]).first().intensity == 1
    c = p.withColumns({"r": F.when(F.col("scan_idx") == 0, 1), "g": F.lit(2), "b": F.lit(3)})
    assert rd.merged_scans(c, "file").where("r is not null or g is not null").count() == 0 and rd.merged_scans(c, "file", [0]).first().g == 2
    frames = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in fu.missing_files(frames, spark.createDataFrame([("a",)], "path string")).collect()] == ["b"]


def test_manual_box_and_tracking_summary(spark, tmp_path):
    assert rd.manual_box(spark, "cam0", 1, 2, 3, 4).first().x2 == 3
    (tmp_path / "t.json").write_text(json.dumps({"tracks": {"7": {"num_detections": 3, "total_points": 9, "duration": 1.5, "centroid": [1.0, 2.0, 3.0]}}}))
    r = rd.read_tracking_summary(spark, str(tmp_path / "t.json")).first()
    assert (r.track_id, r.num_detections, r.centroid[2]) == ("7", 3, 3.0)
    fx.detections(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "d"))
    assert rd.read_detections(spark, str(tmp_path / "d")).count() == 1000 and rd.read_detections(spark, str(tmp_path / "d"), 1).count() == 0


def test_sinks(spark, sf, tmp_path):
    p = fx.points(spark, sf)
    sk.write_classes(p.withColumn("label", F.col("semantic_class")), str(tmp_path / "classes"))
    assert spark.read.parquet(str(tmp_path / "classes")).where("label = 0").count() == p.where("semantic_class = 0").count()
    sk.write_metadata(p, fx.KEYS, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 10
    sk.write_results_csv([spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "b long")], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["b", "id"]
    t = tr.basic_tracks(fx.detections(spark, sf), fx.TRACK_KEYS)
    sk.write_json(sk.nested_tracks(t, fx.TRACK_KEYS), str(tmp_path / "tracks"))
    rows = spark.read.json(str(tmp_path / "tracks")).collect()
    assert len(rows) == 54 and all([d.ts for d in r.detections] == sorted(d.ts for d in r.detections) for r in rows)
    sk.save_selection(p.limit(5), "one", str(tmp_path / "sel"), "first")
    sk.save_selection(p.limit(7), "one", str(tmp_path / "sel"), "again")
    assert sk.load_selection(spark, "one", str(tmp_path / "sel")).count() == 7
    assert [(r.selection_id, r.n, r.note) for r in sk.list_selections(spark, str(tmp_path / "sel")).collect()] == [("one", 7, "again")]
    sk.write_track_cloud(t, ["track_id"], str(tmp_path / "age"))
    assert spark.read.parquet(str(tmp_path / "age")).agg(F.max("red")).first()[0] <= 1
    sk.write_snapshots(tr.accumulation(t, fx.TRACK_KEYS).where("track_id = 0"), ["sequence_no"], str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).where("det_ordinal = 1").agg(F.max("green")).first()[0] == 0
    sk.write_occupants(t.withColumns({"car_id": F.col("track_id"), "occupant": F.lit(0)}), str(tmp_path / "occ"))
    assert spark.read.parquet(str(tmp_path / "occ")).count() == t.count()


def test_sinks_of_models_motion_and_merged_clouds(spark, sf, tmp_path):
    d = tracking._with_points(spark, sf)
    sk.write_models(tr.model_summary(tr.accumulating_tracks(d, fx.TRACK_KEYS), d, fx.TRACK_KEYS), fx.TRACK_KEYS, str(tmp_path / "models"))
    rows = spark.read.json(str(tmp_path / "models")).collect()
    assert len(rows) == d.select(*fx.TRACK_KEYS).distinct().count() and all(r.total_tracked_cars == len(r.tracks) > 0 for r in rows) and rows[0].tracks[0].quality > 0
    p = spark.createDataFrame([(1, 0.0, True), (2, 1.0, False)], "point_id long, x double, is_static boolean")
    sk.write_motion(p, str(tmp_path / "m"), p.where("point_id = 2").select("point_id", "x"))
    assert sorted((r.point_id, r.motion_class) for r in spark.read.parquet(str(tmp_path / "m/points")).collect()) == [(1, "static"), (2, "dynamic"), (2, "temporal")]
    assert spark.read.json(str(tmp_path / "m/statistics")).first().n_temporal == 1
    sk.write_motion(p.where("false"), str(tmp_path / "e"))
    (r,) = spark.read.json(str(tmp_path / "e/statistics")).collect()
    assert (r.n, r.n_static) == (0, 0)
    sk.write_merged(p.select("point_id", "x"), p.select("x").limit(1), str(tmp_path / "both"), {"scale": 1.5})
    (r,) = spark.read.json(str(tmp_path / "both/about")).collect()
    assert (r.total_points, r.original_points, r.model_points, r.scale) == (3, 2, 1, 1.5) and spark.read.parquet(str(tmp_path / "both/points")).count() == 3
