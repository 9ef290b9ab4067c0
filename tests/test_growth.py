"""What grows with the points is neither gathered on the driver nor sent to more cells than it touches."""

import numpy as np

from scanweave.operators import motion as mo
from scanweave.operators import neighbors as nb

SCHEMA = "point_id long, k int, x double, y double, z double"


def cloud(spark, n=300, seed=1, size=2.0):
    p = np.random.default_rng(seed).random((n, 3)) * size
    return p, spark.createDataFrame([(i, 0, *map(float, q)) for i, q in enumerate(p)], SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_new_points_gathers_none_on_the_driver(spark):
    p, df = cloud(spark)
    made = nb.merge_new(df.where("point_id < 150"), df.where("point_id >= 150"), ["k"], 0.2)
    assert "Broadcast" not in plan(made) and "Broadcast" not in plan(nb.radius_pairs(df, df, ["k"], 0.2))
    far = (((p[150:, None] - p[None, :150]) ** 2).sum(-1) > 0.04).all(1)
    assert sorted(r.point_id for r in made.collect()) == [*range(150), *(150 + np.flatnonzero(far)).tolist()]


def test_points_are_sent_to_the_cells_that_they_touch(spark):
    _, df = cloud(spark)
    assert nb.sent(df, 0.1, 0.2).count() <= 8 * 300 and nb.sent(df, 0.1, 0.8).count() < 3 * 300


def test_distances_of_just_the_radius_are_found(spark):
    """Coordinates on the corners of cells, on either side of zero, and far out."""
    at = [v + o for o in (0.0, 1e6) for v in (-0.2, -0.1, 0.0, 0.1, 0.2, 0.30000000000000004)]
    rows = [(i, 0, x, 0.0, 0.1) for i, x in enumerate(at)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if (a - b) * (a - b) + 0.0 + 0.0 <= 0.1 * 0.1}
    assert {(r.a, r.b) for r in nb.radius_pairs(df, df, ["k"], 0.1).collect()} == want


def test_nearest_places_take_one_join_and_no_further_shuffle(spark):
    _, df = cloud(spark)
    scans = df.selectExpr("*", "point_id % 3 as scan")
    made = mo.moving_points(df, scans, ["k"], "scan", 0.2, 0.0)
    near = nb.nearest_places(df, scans, ["k"], "scan", 0.2)
    assert plan(near).count("hashpartitioning") == 2 and plan(near.groupBy("k", *nb._CELLS, "a").count()).count("hashpartitioning") == 2
    assert made.count() > 0


def test_suppression_follows_a_chain(spark):
    """Each point is near the next alone, so every other one is kept, round by round."""
    df = spark.createDataFrame([(i, 0, i * 0.1, 0.0, 0.0) for i in range(12)] + [(99, 0, float("nan"), 0.0, 0.0)], SCHEMA)
    assert sorted(r.point_id for r in mo.suppressed(df, ["k"], 0.15).collect()) == [0, 2, 4, 6, 8, 10, 99]


def test_links_of_cells_shrink_to_what_components_need(spark):
    """All pairs of 60 nodes in two groups, and pairs across that are not sure: a tree a group is left, and pairs across alone are still to ask."""
    from scanweave.operators import scene as sc

    links = [(i, j, i % 2 == j % 2) for i in range(60) for j in range(i)] + [(i, j, False) for i in range(0, 60, 2) for j in range(0, i, 2)]
    rows = sc._spanning(spark.createDataFrame(links, "a long, b long, sure boolean").coalesce(1)).collect()
    assert sum(r.sure for r in rows) == 58 and all((r.a + r.b) % 2 for r in rows if not r.sure) and sum(not r.sure for r in rows) == 900


def test_points_of_an_enclosed_void_are_not_gathered(spark):
    from scanweave.operators import scene as sc

    df = spark.createDataFrame([(0, 0, 0, 0, 0)], "point_id long, k int, gx long, gy long, gz long")
    assert "Broadcast" not in plan(sc.in_voxels(df, df, ["k"])) and "Broadcast" not in plan(sc.enclosed_voxels(df, ["k"]))


def test_model_summaries_gather_no_detections(spark):
    from scanweave.operators import tracking as tr

    made = spark.createDataFrame([(0, 1, 0, 1, 8, *[0.0] * 9)], "k int, det_id long, track_id long, det_ordinal long, n_points long, " + ", ".join(f"{c} double" for c in tr.MODEL))
    seen = spark.createDataFrame([(0, 1, 0.0, "cam0")], "k int, det_id long, ts double, camera string")
    assert "Broadcast" not in plan(tr.model_summary(made, seen, ["k"]))


def test_small_clouds_find_their_nearest_as_one_row(spark, monkeypatch):
    """Beside a cloud that goes by cells; ties go by id, and the mean distances of outliers take no cells at all."""
    rng = np.random.default_rng(7)
    p = {k: rng.integers(0, 6, (n, 3)) / 4 for k, n in ((0, 40), (1, 300), (2, 3))}
    rows = [(1000 * k + len(c) - 1 - i, k, *map(float, q)) for k, c in p.items() for i, q in enumerate(c)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for k, c in p.items():
        c = c[::-1]
        d2 = ((c[:, None] - c[None]) ** 2).sum(-1)
        want |= {(k, 1000 * k + i, 1000 * k + int(j), r + 1) for i in range(len(c)) for r, j in enumerate(np.lexsort((np.arange(len(c)), d2[i]))[:6])}
    for queries, mine in ((df, want), (df.where("point_id % 3 = 0"), {w for w in want if w[1] % 3 == 0})):
        assert {(r.k, r.a, r.b, r.rank) for r in nb.k_nearest(queries, df, ["k"], 6, whole=100).collect()} == mine
    monkeypatch.setattr(nb, "_near", None)
    made = nb.statistical_outliers(df, ["k"], k=5, sigmas=100.0).collect()
    assert len(made) == 343 and "Window" not in plan(nb.k_nearest(df, df, ["k"], 6, whole=300))


def test_scalars_of_clouds_are_gathered_and_not_their_points(spark):
    """Few points of many bytes, so that either side of the join is below the planner's threshold."""
    from scanweave.operators import filters as fl

    _, df = cloud(spark)
    for made in (fl.with_cloud(df, ["k"], *(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", "min"), ("hi", "max")) for f in [getattr(nb.F, f)])), fl.range_outliers(df, ["k"], 0.9)):
        assert "BroadcastHashJoin" in plan(made) and "BuildRight" in plan(made) and "BuildLeft" not in plan(made)


def test_components_gather_no_edges(spark, monkeypatch):
    from scanweave.operators import graph

    seen = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: seen.append(plan(df)) or keep(df, name))
    rows = graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()
    assert {(r.node, r.label) for r in rows} == {(i, 0) for i in range(10)} and not any("Broadcast" in p for p in seen)


def test_nearest_of_each_scan_are_swept(spark, monkeypatch):
    """Batches of few rows, pairs that are thinned, ties, crowded places and cells' ends, of a table with itself and of another; Spark joins nothing."""
    monkeypatch.setitem(mo.nearest_by_scan.__globals__, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(3)
        at = np.vstack([rng.integers(-12, 12, (150, 3)) * 0.05, rng.random((150, 3)) * 0.2, rng.random((60, 3)) * 30 - 15])
        df = spark.createDataFrame([(i, 0, i * 7 % 4, *map(float, q)) for i, q in enumerate(at)] + [(999, 0, 1, float("nan"), 0.0, 0.0)], "point_id long, k int, scan int, x double, y double, z double")
        d = at[:, None] - at[None]
        d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
        want = {(i, s, min((d2[i, j], j) for j in range(360) if j * 7 % 4 == s and d2[i, j] <= 0.0144)[1]) for i in range(360) for s in {int(j) * 7 % 4 for j in np.flatnonzero(d2[i] <= 0.12 * 0.12)}}
        for asked in (df, df.where("point_id % 2 = 0")):
            made = mo.nearest_by_scan(asked, df, ["k"], "scan", 0.12)
            got = [(r.a, p.scan, p.b) for r in made.collect() for p in r.places]
            assert len(got) == len(set(got)) and set(got) == {w for w in want if asked is df or w[0] % 2 == 0} and "Join" not in plan(made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
