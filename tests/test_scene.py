"""Neighbours, clusters, quantiles, motion, trackers and occupants against brute force, and properties of transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.operators import filters as fl
from scanweave.operators import geometry as ge
from scanweave.operators import motion as mo
from scanweave.operators import neighbors as nb
from scanweave.operators import occupants as oc
from scanweave.operators import order
from scanweave.operators import scene as sc
from scanweave.operators import select as se
from scanweave.operators import stats as st
from scanweave.operators import tracking as tr
from scanweave.plans import fixtures as fx
from scanweave.plans import tracking
from scanweave.schema import Params


def cloud(spark, n=300, seed=1, size=2.0):
    p = np.random.default_rng(seed).random((n, 3)) * size
    return p, spark.createDataFrame([(i, 0, *map(float, q)) for i, q in enumerate(p)], "point_id long, k int, x double, y double, z double")


def test_radius_pairs_and_nearest(spark):
    p, df = cloud(spark)
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    got = {(r.a, r.b) for r in nb.radius_pairs(df, df, ["k"], 0.3).collect()}
    assert got == set(zip(*map(list, np.where(d2 <= 0.09)), strict=True))
    near = nb.k_nearest(df.where("point_id < 50"), df, ["k"], 5, start=0.1).collect()
    for i in range(50):
        assert [r.b for r in sorted((r for r in near if r.a == i), key=lambda r: r.rank)] == list(np.argsort(d2[i], kind="stable")[:5])


def test_nearest_in_an_uneven_cloud(spark, monkeypatch):
    """A heap of a centimetre, a thin part over a hundred metres, and one point far away: as few rounds, and about as few pairs, as an even cloud."""
    rng = np.random.default_rng(4)
    even = rng.random((600, 3)) * 4
    uneven = np.vstack([rng.random((300, 3)) * 0.01, rng.random((299, 3)) * 100, [[5000.0, 0, 0]]])
    rounds, pairs = {}, {}
    near = nb._near
    for name, p in (("even", even), ("uneven", uneven)):
        df = spark.createDataFrame([(i, 0, *map(float, q)) for i, q in enumerate(p)], "point_id long, k int, x double, y double, z double")
        seen = []
        monkeypatch.setattr(nb, "_near", lambda *a: seen.append(near(*a)) or seen[-1])  # noqa: B023
        rows = nb.k_nearest(df, df, ["k"], 6).collect()
        d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
        want = {(i, int(j), r + 1) for i in range(len(p)) for r, j in enumerate(np.lexsort((np.arange(len(p)), d2[i]))[:6])}
        assert {(r.a, r.b, r.rank) for r in rows} == want
        rounds[name], pairs[name] = len(seen), seen[0].count()
    assert rounds["uneven"] <= rounds["even"] + 4 and pairs["uneven"] < 20 * pairs["even"]


def _compared(rim, p, r):
    """How many pairs of points are looked at one by one."""
    n = 0
    held = {}
    for row in rim.collect():
        if row.level not in held:
            cells, counts = np.unique(np.floor(p / (r / 2**row.level)), axis=0, return_counts=True)
            held[row.level] = {tuple(c): k for c, k in zip(cells.tolist(), counts.tolist(), strict=True)}
        n += held[row.level][tuple(row.q)] * held[row.level][tuple(row.c)]
    return n


@pytest.mark.parametrize("few", [300, nb.FEW_PAIRS])
def test_counts_of_neighbours_in_crowded_cells(spark, monkeypatch, few):
    """A heap, a plane, copies of one point and a thin part, in two clouds: as brute force; crowded cells are counted as cells."""
    monkeypatch.setattr(nb, "FEW_PAIRS", few)
    rng = np.random.default_rng(8)
    clouds = {0: np.vstack([rng.random((700, 3)) * 0.2 - 0.1, rng.random((300, 3)) * [4, 4, 0] - 2, np.full((200, 3), 0.75), rng.random((200, 3)) * 20 - 10]), 1: rng.random((900, 3)) * 0.6}
    rows = [(k * 10_000 + i, k, *map(float, q)) for k, p in clouds.items() for i, q in enumerate(p)] + [(-1, 0, float("nan"), 0.0, 0.0), (-2, 0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id long, k int, x double, y double, z double").repartition(3)
    got = {r.point_id: r.neighbours for r in nb.local_density(df, ["k"], 0.25).collect()}
    some = {r.point_id: r.n for r in nb.neighbour_counts(df.where("point_id % 3 = 0"), df.where("point_id % 2 = 0"), ["k"], 0.25).collect()}
    want, apart = {}, {}
    for k, p in clouds.items():
        d = p[:, None] - p[None]
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= 0.25 * 0.25
        ids = k * 10_000 + np.arange(len(p))
        want |= dict(zip(ids.tolist(), near.sum(1).tolist(), strict=True))
        apart |= {i: n for i, n in zip(ids.tolist(), near[:, ids % 2 == 0].sum(1).tolist(), strict=True) if i % 3 == 0 and n}
    assert got == want and some == apart
    assert nb.local_density(df.limit(0), ["k"], 0.25).count() == 0


def test_dense_clouds_are_counted_without_all_pairs(spark, monkeypatch):
    """Eight times the density is 64 times the pairs of points; those looked at one by one, and the pairs of cells, grow by clearly less."""
    monkeypatch.setattr(nb, "FEW_PAIRS", 16)
    looked, cells = [], []
    for n in (500, 4000):
        p, df = cloud(spark, n, seed=3, size=1.0)
        inside, rim, _ = nb.cell_pairs(df, df, ["k"], 0.4)
        looked.append(_compared(rim, p, 0.4))
        cells.append(rim.count())
        assert inside.agg(F.sum("n")).first()[0] > 0
    assert looked[1] < 48 * looked[0] and cells[1] < 48 * cells[0]


def test_own_pairs_are_each_pair_once(spark):
    p, df = cloud(spark)
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    rows = nb.own_pairs(df, ["k"], 0.3).collect()
    assert len(rows) == len({frozenset((r.a, r.b)) for r in rows}) and {frozenset((r.a, r.b)) for r in rows} == {frozenset((int(i), int(j))) for i, j in zip(*np.where(d2 <= 0.09), strict=True) if i != j}


def test_points_that_are_not_finite_are_near_nothing(spark):
    _, df = cloud(spark, 40)
    bad = df.union(spark.createDataFrame([(100, 0, float("nan"), 1.0, 1.0), (101, 0, None, 1.0, 1.0), (102, 0, float("inf"), 1.0, 1.0), (103, 0, -1e300, 1.0, 1.0)], df.schema))
    assert nb.k_nearest(bad, bad, ["k"], 3).where("a >= 100 or b >= 100").count() == 0 and nb.k_nearest(bad, bad, ["k"], 3).count() == 120
    assert nb.local_density(bad, ["k"], 0.5).count() == 40
    got = sc.clusters(bad, ["k"], 0.5, 2)
    assert got.count() == 44 and {r.cluster_id for r in got.where("point_id >= 100").collect()} == {-1}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.65, 0.95, 1.0])
def test_quantiles(spark, q):
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=12_000), np.exp(rng.normal(size=2500) * 20), np.round(rng.random(900) * 5), np.full(700, 3.25), rng.random(7), -rng.random(300) * 1e-310, np.array([0.0, -0.0, 1.0])]
    rows = [(k, float(v)) for k, g in enumerate(groups) for v in g] + [(0, None), (99, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    got = {r.k: (r.a, r.b) for r in order.exact_quantiles(df, ["k"], {"a": ("v", q), "b": ("v", 0.25)}).collect()}
    assert got.pop(99) == (None, None)
    for k, g in enumerate(groups):
        assert np.allclose(got[k], (np.quantile(g, q), np.quantile(g, 0.25)), rtol=1e-12, atol=0)


@pytest.mark.parametrize("n", [40, 10_500])
def test_quantiles_of_values_that_are_no_numbers(spark, n):
    """NaN does not count, infinities are ends, and a search ends whatever the values."""
    base = np.random.default_rng(2).normal(size=n)
    extra = {0: [np.nan], 1: [np.inf], 2: [1e308, -1e308], 3: [-np.inf, np.inf, np.nan], 4: [5e-324, -5e-324, 2.2250738585072014e-308]}
    rows = [(k, float(v)) for k, more in extra.items() for v in [*base, *more]] + [(5, float("nan"))] * 3 + [(6, float("inf"))] * 2 + [(6, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r.k: r for r in order.exact_quantiles(df, ["k"], {"low": ("v", 0.0), "mid": ("v", 0.5), "most": ("v", 0.95), "all": ("v", 1.0)}).collect()}
    for k, more in extra.items():
        own = np.sort([v for v in [*base, *more] if not np.isnan(v)])
        assert got[k].low == own[0] and got[k]["all"] == own[-1]
        assert np.isclose(got[k].mid, np.quantile(own, 0.5), rtol=1e-12) and np.isclose(got[k].most, np.quantile(own, 0.95), rtol=1e-12)
    assert tuple(got[5])[1:] == (None,) * 4 and tuple(got[6])[1:] == (1.0, float("inf"), float("inf"), float("inf"))


def test_longs_are_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.integers(-(2**63), 2**63, 20_000).view(np.float64), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1024), 0), [0.0, np.inf, -np.inf, 1e308]])
    v = v[~np.isnan(v)]
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order.double_order(F.col("v")).alias("k")).collect()
    bits = np.array([r.v for r in rows]).view(np.int64)
    want = np.where(bits < 0, -(bits & 0x7FFFFFFFFFFFFFFF), bits)
    assert [r.k for r in rows] == want.tolist()


def test_numbers_of_large_groups(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = order.numbered(df, ["k"], ["v"]).toPandas()
    for _, g in got.groupby("k"):
        assert (g.sort_values("v").r.to_numpy() == np.arange(len(g))).all()
    assert se.stride(df, ["k"], "v", 10).count() == sum(-(-n // 10) for n in (1667, 1667, 1666))


def test_boxes_of_any_size(spark):
    p, df = cloud(spark, 200, 9, 50.0)
    rng = np.random.default_rng(2)
    boxes = [(f"b{i}", *(float(v) for a in range(3) for lo in [rng.random() * 40] for v in (lo, lo + side))) for i, side in enumerate((0.5, 3, 9, 30, 200, 20_000))]
    b = spark.createDataFrame(boxes, "box_id string, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double")
    got = {(r.point_id, r.box_id) for r in nb.in_boxes(df, b, ["k"]).collect()}
    assert got == {(i, n) for i, q in enumerate(p) for n, x0, x1, y0, y1, z0, z1 in boxes if x0 <= q[0] <= x1 and y0 <= q[1] <= y1 and z0 <= q[2] <= z1}


def test_stated_sets_of_any_size(spark, monkeypatch):
    p, df = cloud(spark, 30)
    t = spark.createDataFrame([(f"t{k}", float(k), 0.0, 0.0, 1.0, 30.0) for k in range(25)], "transform_id string, cx double, cy double, cz double, scale double, rotation_deg double")
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(ge.transformed(df, t))
    monkeypatch.setattr(fl, "STATED", 4)
    many = ge.transformed(df, t)
    assert rows(many) == want and len(want) == 750 and rows(ge.transformed(df, t.where("false"))) == []
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_nested_loop(spark):
    _, df = cloud(spark)
    t = spark.createDataFrame([("t", 0.0, 0.0, 0.0, 1.0, 30.0)], "transform_id string, cx double, cy double, cz double, scale double, rotation_deg double")
    for made in (nb.radius_pairs(df, df, ["k"], 0.3), nb.own_pairs(df, ["k"], 0.3), ge.transformed(df, t)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def dbscan(p, eps, least):
    near = [np.flatnonzero(((p - q) ** 2).sum(1) <= eps * eps) for q in p]
    core = [len(n) >= least for n in near]
    label, now = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = now
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = now
                        todo.append(j)
            now += 1
    for i in range(len(p)):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


@pytest.mark.parametrize("eps,least", [(0.25, 4), (0.1, 3), (0.6, 5), (0.35, 8), (1.5, 9)])
def test_clusters(spark, eps, least):
    p, df = cloud(spark, 400, 3)
    got = {r.point_id: r.cluster_id for r in sc.clusters(df, ["k"], eps, least).collect()}
    assert [got[i] for i in range(len(p))] == dbscan(p, eps, least).tolist()


def test_void_of_a_hollow_box(spark):
    shell = [(i, j, k) for i in range(9) for j in range(9) for k in range(9) if 0 in (i, j, k) or 8 in (i, j, k)]
    df = spark.createDataFrame([(n, 0, i + 0.5, j + 0.5, k + 0.5) for n, (i, j, k) in enumerate([*shell, (4, 4, 4)])], "point_id long, k int, x double, y double, z double")
    inside = {(i, j, k) for i in range(1, 8) for j in range(1, 8) for k in range(1, 8)} - {(4, 4, 4)}
    occupied = {*shell, (4, 4, 4)}
    cells = df.selectExpr("k", *(f"cast({a} - 0.5 as long) as g{a}" for a in "xyz"))
    assert {(r.gx, r.gy, r.gz) for r in sc.enclosed_voxels(cells, ["k"]).collect()} == inside
    far = {v for v in inside if min(sum(abs(a - b) for a, b in zip(v, o, strict=True)) for o in occupied) >= 2}
    assert {(r.gx, r.gy, r.gz) for r in sc.void_voxels(cells, ["k"], 2).collect()} == far
    got = {r.point_id for r in sc.with_void_interior(df, ["k"], 1.0, 2).where("is_interior").collect()}
    assert got == {n for n, o in enumerate([*shell, (4, 4, 4)]) if min(sum(abs(a - b) for a, b in zip(o, v, strict=True)) for v in far) <= 2}


def test_distance_map_and_morphology(spark):
    """Passes along the axes against all distances; opening and closing against their definitions."""
    rng = np.random.default_rng(3)
    cells = {tuple(map(int, c)) for c in rng.integers(0, 8, (60, 3))} | {(i, j, k) for i in range(20, 24) for j in range(4) for k in range(4)}
    df = spark.createDataFrame([(0, *c) for c in cells], "k int, gx long, gy long, gz long")
    sets = lambda d: {(r.gx, r.gy, r.gz) for r in d.collect()}
    far = {(r.gx, r.gy, r.gz): r.distance for r in sc.distance_map(df, ["k"], 3).collect()}
    all_ = {(i, j, k): min(abs(i - a) + abs(j - b) + abs(k - c) for a, b, c in cells) for i in range(-4, 28) for j in range(-4, 12) for k in range(-4, 12)}
    assert far == {c: d for c, d in all_.items() if d <= 3}
    near = lambda s, n: {(x + i, y + j, z + k) for x, y, z in s for i, j, k in sc._around(n)}
    inner = lambda s: {c for c in s if near({c}, 1) <= s}
    assert sets(sc.eroded(df, ["k"], 2)) == inner(inner(cells)) and sets(sc.opened(df, ["k"], 1)) == near(inner(cells), 1)
    assert sets(sc.closed(df, ["k"], 1)) == inner(near(cells, 1)) and sets(sc.dilated(df, ["k"], 2)) == near(cells, 2)


def test_a_stray_point_makes_no_voxels(spark):
    shell = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if 0 in (i, j, k) or 4 in (i, j, k)]
    cells = spark.createDataFrame([(0, *c) for c in [*shell, (2, 2, 10**9), (2, 10**9, 2)]], "k int, gx long, gy long, gz long")
    assert sc.enclosed_voxels(cells, ["k"]).count() == 27


def test_points_that_are_not_finite_have_no_voxel(spark):
    p, df = cloud(spark, 60)
    bad = df.union(spark.createDataFrame([(100, 0, float("nan"), 1.0, 1.0), (101, 0, float("inf"), 1.0, 1.0), (102, 0, -float("inf"), 1.0, 1.0), (103, 0, 1.0, None, 1.0)], df.schema))
    for made in (lambda d: st.occupancy(d, ["k"], 0.5), lambda d: st.down_sampled(d, ["k"], 0.5)):
        assert np.allclose(sorted(map(tuple, made(bad).collect())), sorted(map(tuple, made(df).collect())))
    assert sc.with_void_interior(bad, ["k"], 0.5, 1).count() == 64
    got = fl.range_outliers(bad, ["k"], 0.95)
    assert got.where("point_id >= 100").count() == 0 and 55 < got.count() < 60
    done = sc.ScenePipeline().run(bad, ["k"], Params(eps=0.6, min_samples=5))
    assert done.where("point_id >= 100").count() == 0


def test_planes_count_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    p = np.c_[rng.random((3000, 2)) * 10, rng.normal(size=3000) * 0.02]
    df = spark.createDataFrame([(i, i % 2, *map(float, q)) for i, q in enumerate(p)], "point_id long, k int, x double, y double, z double")
    whole = sorted(map(tuple, sc.ground_planes(df, ["k"]).collect()))
    monkeypatch.setattr(sc, "PART", 100)
    parts = sorted(map(tuple, sc.ground_planes(df, ["k"]).collect()))
    assert len(whole) == 2 and np.allclose(whole, parts) and np.allclose([r[1:] for r in whole], 0, atol=0.01)


def test_noise_is_of_the_point(spark):
    df = spark.range(20_000).selectExpr("id - 50 as point_id", "0D as x", "0D as y", "0D as z")
    a = ge.jittered(df, 2.0).orderBy("point_id").toPandas()
    b = ge.jittered(df.repartition(7), 2.0).orderBy("point_id").toPandas()
    v = a[["x", "y", "z"]].to_numpy()
    assert a.equals(b) and np.abs(v.mean(0)).max() < 0.06 and np.abs(v.std(0) - 2).max() < 0.05
    assert np.abs(np.corrcoef(v.T) - np.eye(3)).max() < 0.03 and np.abs(np.corrcoef(v[:-1].T, v[1:].T)[:3, 3:]).max() < 0.03
    share = [(np.abs(v) < 2 * s).mean() for s in (0.5, 1, 2, 3)]
    assert np.allclose(share, [0.3829, 0.6827, 0.9545, 0.9973], atol=0.01) and (np.sort(v[:, 0]) != np.sort(ge.jittered(df, 2.0, seed=7).toPandas().x)).any()


def test_occupants_merge_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, i // 3, *map(float, rng.random(3) * 2), 0.5, 2) for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "car int, cand_id long, frame_id int, x double, y double, z double, confidence double, n_points int")
    got = {(r.car, r.occupant): r.candidates for r in oc.merged_occupants(df, ["car"]).collect()}
    want = {}
    for c in (1, 2):
        known = []
        for r in [r for r in rows if r[0] == c]:
            k = next((k for k, q in enumerate(known) if np.linalg.norm(np.subtract(q, r[3:6])) < 0.5), len(known))
            if k == len(known):
                known.append(r[3:6])
            want[c, k] = want.get((c, k), 0) + 1
    assert got == want


def test_empty_clouds_pass_through(spark):
    _, df = cloud(spark, 3)
    done = sc.ScenePipeline().run(df.where("false"), ["k"])
    assert done.count() == 0 and {"is_ground", "is_vehicle", "is_interior", "is_cockpit"} <= set(done.columns)


def test_pipeline_steps_can_change(spark):
    p = sc.ScenePipeline()
    p.remove_step("cockpit").add_step("mark", lambda df, keys, params: df.withColumn("mark", F.lit(1)))
    assert [n for n, _ in p.steps] == ["outliers", "ground", "vehicle", "interior", "mark"]


def test_suppression_is_the_sequential_pass(spark):
    p, df = cloud(spark, 250, 5, 1.0)
    gone, kept = set(), []
    for i, q in enumerate(p):
        if i not in gone:
            kept.append(i)
            gone |= set(np.flatnonzero(((p - q) ** 2).sum(1) <= 0.04).tolist())
    assert sorted(r.point_id for r in mo.suppressed(df, ["k"], 0.2).collect()) == kept


def test_static_points_by_the_sequential_pass(spark):
    """Down-sampling of each scan, then point by point in order of ids."""
    p, _ = cloud(spark, 500, 6, 1.0)
    scan = np.arange(500) % 4
    df = spark.createDataFrame([(i, 0, int(scan[i]), *map(float, q)) for i, q in enumerate(p)], "point_id long, k int, scan_idx int, x double, y double, z double")
    size, r = 0.3, 0.2
    thin = []
    for s in range(4):
        own = np.flatnonzero(scan == s)
        cell = np.floor((p[own] - (p[own].min(0) - size / 2)) / size)
        for c in np.unique(cell, axis=0):
            m = own[(cell == c).all(1)]
            thin.append((int(m.min()), s, p[m].mean(0)))
    thin.sort(key=lambda t: t[0])
    at, of = np.array([t[2] for t in thin]), np.array([t[1] for t in thin])
    gone, want = np.zeros(len(thin), bool), {}
    for i, (n, _, q) in enumerate(thin):
        if not gone[i]:
            near = ((at - q) ** 2).sum(1) <= r * r
            gone |= near
            want[n] = len(set(of[near])) / 4
    got = {x.point_id: x for x in mo.static_points(df, ["k"], r=r, voxel=size).collect()}
    assert {n: x.share for n, x in got.items()} == want and {n for n, x in got.items() if x.is_static} == {n for n, v in want.items() if v >= 0.7}
    r = mo.static_statistics(mo.static_points(df, ["k"], r=r, voxel=size), ["k"]).first()
    assert (r.n, r.n_static) == (len(want), sum(v >= 0.7 for v in want.values())) and 0 < r.n_static < r.n


def test_temporal_change_of_all_scans(spark, sf):
    m = fx.moving(spark, sf)
    assert m.count() == 5 * spark.read.parquet(f"{sf}/events.parquet").count()
    got = {r.device_no: r for r in tracking.m7_m8_temporal_change(spark, sf).collect()}
    for device, g in m.toPandas().sort_values("point_id").groupby("device_no"):
        p, scan = g[["x", "y", "z"]].to_numpy(), g.scan_idx.to_numpy()  # no two points of a scan share a voxel here
        square = lambda q: ((p - q) ** 2).sum(1)
        gone, dynamic = np.zeros(len(p), bool), []
        for i, q in enumerate(p):
            if not gone[i]:
                near = square(q) <= 0.05**2
                gone |= near
                if len(set(scan[near])) / 5 < 0.7:
                    dynamic.append(q)
        far = []
        for q in dynamic:
            d = square(q)
            ends = [p[near[d[near].argmin()]] for s in range(5) if len(near := np.flatnonzero((scan == s) & (d <= 0.06**2)))]
            if len(ends) >= 2 and (step := np.sqrt(((ends[-1] - ends[0]) ** 2).sum())) > 0.05:
                far.append(step)
        r = got[device]
        assert (r.n_dynamic, r.n_moving) == (len(dynamic), len(far)) and len(far) > 0
        assert abs(r.mean_displacement - np.mean(far)) < 1e-5


def test_rotations_undo_each_other(spark):
    p, df = cloud(spark, 50)
    c = F.lit(1.0)
    back = ge.rotated(ge.rotated(df, c, c, F.lit(33.0)), c, c, F.lit(-33.0)).orderBy("point_id").toPandas()[["x", "y", "z"]].to_numpy()
    whole = ge.rotated(df, c, c, F.lit(360.0)).orderBy("point_id").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(back, p) and np.allclose(whole, p)


def test_tracker_ignores_row_order(spark, sf):
    d = fx.detections(spark, sf)
    a = {(r.det_id, r.track_id) for r in tr.basic_tracks(d, fx.TRACK_KEYS).collect()}
    b = {(r.det_id, r.track_id) for r in tr.basic_tracks(d.orderBy(F.rand(3)), fx.TRACK_KEYS).collect()}
    assert a == b and len({(r // 240, t) for r, t in a}) == 54


def test_stale_tracks_go():
    t = tr.Tracks(Params())
    for k in range(500):
        t.take((2.0 * k, "cam0", 0.0, 0.0, None, None, None))
    assert t.number == 500 and len(t.last) == 1


def accumulated(rows, p):
    """The accumulating tracker, written plainly: every track is kept for good."""
    tracks, out, call, known = [], [], None, 0
    for d in rows:
        if (d.ts, d.camera) != call:
            call, known = (d.ts, d.camera), len(tracks)
        pts = np.array([(q.x, q.y, q.z) for q in d.points])
        best, low = None, np.inf
        for k in range(known):
            far, age = np.linalg.norm(np.mean(tracks[k]["pts"], axis=0) - pts.mean(0)), d.ts - tracks[k]["ts"]
            if far <= p.model_distance and age <= p.model_gap and far + 0.1 * age < low:
                best, low = k, far + 0.1 * age
        away = np.linalg.norm(pts - np.median(pts, axis=0), axis=1)
        clean = pts[away <= away.mean() + 2 * away.std()] if len(pts) > 2 else pts
        if best is None:
            best = len(tracks)
            tracks.append({"pts": list(clean)})
        else:
            old = np.array(tracks[best]["pts"])
            tracks[best]["pts"] += [q for q in clean if np.linalg.norm(old - q, axis=1).min() > p.merge_distance]
        tracks[best]["ts"] = d.ts
        out.append((d.det_id, best))
    return tracks, out


def test_accumulating_tracker(spark, sf):
    """A sequence in two stretches, five seconds apart, and one without a pause."""
    d = tracking._with_points(spark, sf).withColumn("ts", F.when((F.col("sequence_no") == 1) & (F.col("frame_id") >= 20), F.col("ts") - 5).otherwise(F.col("ts")))
    # off the grid, where distances are not the limit itself but for rounding
    d = d.withColumn("points", F.transform("points", lambda q: F.struct((q.x * 1.0137).alias("x"), q.y.alias("y"), q.z.alias("z"))))
    assert {r.n for r in tr.gap_segments(d, fx.TRACK_KEYS, 1.5).groupBy("sequence_no").agg(F.max("segment_id").alias("n")).collect()} >= {0, 1}
    rows = sorted(d.collect(), key=lambda r: (r.ts, r.camera, r.det_seq, r.det_id))
    made = {(r.sequence_no, r.det_id): r for r in tr.accumulating_tracks(d.orderBy(F.rand(1)), fx.TRACK_KEYS).collect()}
    summary = {(r.sequence_no, r.track_id): r for r in tr.model_summary(tr.accumulating_tracks(d, fx.TRACK_KEYS), d, fx.TRACK_KEYS).collect()}
    n = 0
    for s in {r.sequence_no for r in rows}:
        tracks, out = accumulated([r for r in rows if r.sequence_no == s], Params())
        times = {k: [i for i, (_, t) in enumerate(out) if t == k] for k in range(len(tracks))}
        assert {d: t for d, t in out if len(times[t]) > 1} == {k[1]: r.track_id for k, r in made.items() if k[0] == s}
        for k, t in enumerate(tracks):
            if len(times[k]) > 1:
                r, pts = summary[s, k], np.array(t["pts"])
                assert (r.n_points, r.n_detections) == (len(pts), len(times[k]))
                assert np.allclose([r.centre_x, r.centre_y, r.centre_z, r.size_x, r.size_y, r.size_z], [*pts.mean(0), *np.ptp(pts, axis=0)])
                assert np.isclose(r.quality, min(1, len(pts) / 100 * len(times[k]) / 5))
                n += 1
    assert n == len(summary) > 10 and any(r.n_new < 8 for r in made.values())


def test_footprints(spark):
    p, _ = cloud(spark, 400, 12)
    rows = [(i % 2, *map(float, q)) for i, q in enumerate(p)] + [(5, 0.0, 0.0, 0.0)] * 3 + [(6, float(k), 2.0 * k, 0.0) for k in range(9)]
    got = {r.k: r for r in tr.footprints(spark.createDataFrame(rows, "k int, x double, y double, z double").repartition(7), ["k"]).collect()}
    assert set(got) == {0, 1, 6} and got[6].area == 0 and got[0].n == 200
    for k in (0, 1):
        q = p[np.arange(400) % 2 == k][:, :2]
        at, corners = int(q[:, 0].argmin()), []
        while not corners or at != corners[0]:  # wrapping: the next corner has all points on its left
            corners.append(at)
            at = next(j for j in range(len(q)) if j != at and all((q[j, 0] - q[at, 0]) * (v[1] - q[at, 1]) - (q[j, 1] - q[at, 1]) * (v[0] - q[at, 0]) >= -1e-15 for v in q))
        h = q[corners]
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(h, np.roll(h, -1, 0), strict=True)) / 2
        assert got[k].corners == len(corners) and np.isclose(got[k].area, area)


def test_principal_direction(spark):
    rng = np.random.default_rng(3)
    clouds = [rng.normal(size=(200, 3)) * s @ np.linalg.qr(rng.normal(size=(3, 3)))[0] for s in ([5, 1, 1], [1, 3, 2], [0.1, 0.2, 4])]
    df = spark.createDataFrame([(k, *map(float, q)) for k, c in enumerate(clouds) for q in c] + [(9, 0.0, 0.0, 0.0)], "k int, x double, y double, z double")
    got = {r.k: r for r in oc.principal_direction(df, ["k"]).collect()}
    assert set(got) == {0, 1, 2}
    for k, c in enumerate(clouds):
        _, s, v = np.linalg.svd(c - c.mean(0), full_matrices=False)
        axis = v[0] * np.sign(v[0][2])
        assert np.allclose([got[k].ax, got[k].ay, got[k].az], axis) and np.isclose(got[k].explained, s[0] ** 2 / (s**2).sum())
        assert np.isclose(got[k].yaw, np.arctan2(axis[1], axis[0])) and np.isclose(got[k].pitch, np.arcsin(axis[2]))


def test_people_count(spark):
    rng = np.random.default_rng(7)
    people = [rng.normal(size=(n, 3)) * 0.1 + c for n, c in ((60, 0), (40, 3), (15, 6), (90, 9))]
    far = rng.random((20, 3)) * 100 + 50
    p = np.vstack([*people, far])
    df = spark.createDataFrame([(i, 0, *map(float, q)) for i, q in enumerate(p)] + [(900 + i, 1, 0.0, 0.0, 0.0) for i in range(9)], "point_id long, k int, x double, y double, z double")
    label = dbscan(p, 0.3, 10)
    want = sum((label == c).sum() > 20 for c in set(label.tolist()) if c >= 0)
    assert {r.k: r.people for r in oc.human_count(df, ["k"]).collect()} == {0: want, 1: 0} and want == 3


def test_points_merge_by_cells():
    rng = np.random.default_rng(0)
    a, b = rng.random((80, 3)), rng.random((60, 3))
    want = [q for q in b if np.sqrt(((a - q) ** 2).sum(1)).min() > 0.1]
    m = tr.Models(Params(merge_distance=0.1))
    m.add(3, a)
    assert np.allclose(m.merged(3, b), want) and len(m.merged(4, b)) == 60 and len(m.merged(3, b[:0])) == 0
    m.cells.forget(3)
    assert not m.cells and len(m.merged(3, b)) == 60


def test_work_of_a_track_does_not_grow():
    """Cells that a detection looks at, whatever the track has gathered."""
    m, looked = tr.Models(Params()), []
    get = m.cells.get
    m.cells.get = lambda key: looked[-1].append(key) or get(key)
    rng = np.random.default_rng(1)
    for k in range(300):
        looked.append([])
        m.take(k, k * 0.1, "cam0", *(rng.random((3, 8)) * 2).tolist())
    assert m.number == 1 and m.open[0][2] > 2000 and max(map(len, looked)) <= 8 * 28


def test_ground_falls_back(spark):
    _, df = cloud(spark, 20)
    got = sc.with_ground(df, ["k"], Params())
    low = df.agg(F.min("z")).first()[0]
    assert got.where("is_ground").count() == df.where(F.col("z") <= low + 0.2).count()


def test_small_geometry(spark):
    t = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0), (float("nan"), 0.0, 0.0, 0.0, None)], "cx double, cy double, cz double, scale double, rotation_deg double")
    assert [r.errors for r in fl.transform_problems(t).collect()] == ["", "centre,scale,rotation"]
    r = spark.range(1).select(ge.clamp(F.lit(9.0), 0.1, 3.0).alias("a"), ge.normal_rotation(F.lit(-30.0)).alias("b")).first()
    assert (r.a, r.b) == (3.0, 330.0)
    _, df = cloud(spark, 100)
    assert fl.range_outliers(df, ["k"], accuracy=10_000).count() in range(90, 97)
