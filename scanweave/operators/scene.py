"""The scene: ground plane, clusters, vehicle, interior, cockpit, as steps that add flags to a cloud's points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanweave.functions.scratch import written
from scanweave.schema import Params

from .filters import range_outliers, with_cloud
from .geometry import voxels
from .graph import components
from .neighbors import _CELLS, WHOLE, cell_join, finite, k_nearest, merged, radius_pairs, spread, square
from .order import exact_quantiles
from .select import order_hash

Step = Callable[[DataFrame, list[str], Params], DataFrame]


#: Points of a cloud that one task counts for all trials, and trials that it counts at once.
PART, STRIP = 20_000, 64


def _votes(low: DataFrame, planes: DataFrame, keys: list[str], residual: float) -> DataFrame:
    """``keys, trial, n``: points near each trial's plane. A cloud's points (with their number ``__n``) meet its trials in parts, each as arrays, so a part
    gives a row of counts and no row for a point and a trial."""
    part = F.pmod(F.xxhash64("point_id"), F.ceil(F.col("__n") / PART)).alias("part")
    cloud = low.groupBy(*keys, part).agg(*(F.collect_list(a).alias(a) for a in "xyz"))
    trials = planes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trial", "a", "b", "c"))).alias("planes"))
    both = cloud.join(merged(trials), keys).select(*keys, *"xyz", *(F.col(f"planes.{c}").alias(c) for c in ("trial", "a", "b", "c")))
    made = T.StructType([*(low.schema[k] for k in keys), T.StructField("trial", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType()))])
    kind = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            of = {c: rows.column(c) for c in ("x", "y", "z", "a", "b", "c")}
            for r in range(rows.num_rows):
                x, y, z, a, b, c = (v[r].values.to_numpy(zero_copy_only=False) for v in of.values())
                n = np.zeros(len(a), np.int64)
                for at in range(0, len(a), STRIP):
                    p, q, d = (v[at : at + STRIP, None] for v in (a, b, c))
                    n[at : at + STRIP] = (np.abs(z - (p * x + q * y + d)) <= residual).sum(1)
                own = [rows.column(k).slice(r, 1) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, rows.column("trial").slice(r, 1).cast(kind.field("trial").type), pa.array([n.tolist()], kind.field("n").type)], schema=kind)

    counted = both.mapInArrow(run, made).select(*keys, F.explode(F.arrays_zip("trial", "n")).alias("v"))
    return counted.groupBy(*keys, F.col("v.trial").alias("trial")).agg(F.sum("v.n").alias("n")).where("n > 0")


def ground_planes(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """M1: ``keys, a, b, c`` of z = ax + by + c for clouds with enough candidates.

    Trials are fixed triples of the candidates first by hash; each counts the candidates near its plane; the best (the first of equals) is refitted
    to those by least squares, from sums. Candidates are never gathered as a cloud, nor joined to trials: parts of a cloud are counted for all trials at
    once, so a cloud of any size is many tasks. All trials are counted to the end, as any bound that spares some could only be used after most points.
    """
    band = written(with_cloud(finite(points), keys, F.min("z").alias("z_min")).where(F.col("z") <= F.col("z_min") + p.ground_band).select(*keys, "point_id", "x", "y", "z"), "low")
    low = with_cloud(band, keys, F.count("*").alias("__n")).where(F.col("__n") >= p.ground_candidates)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order_hash(), "point_id"))
    first = low.withColumn("rank", number).where(F.col("rank") <= 3 * p.ground_trials).withColumn("rank", F.col("rank") - 1)
    pick = lambda k: [F.max(F.when(F.col("rank") % 3 == k, F.col(a))).alias(f"{a}{k}") for a in "xyz"]
    three = first.groupBy(*keys, F.floor(F.col("rank") / 3).alias("trial")).agg(F.count("*").alias("m"), *pick(0), *pick(1), *pick(2)).where("m = 3")
    d = "((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))"
    plane = three.where(f"abs{d} > 1e-9")
    plane = plane.withColumn("a", F.expr(f"((z1 - z0) * (y2 - y0) - (z2 - z0) * (y1 - y0)) / {d}")).withColumn("b", F.expr(f"((x1 - x0) * (z2 - z0) - (x2 - x0) * (z1 - z0)) / {d}"))
    plane = written(plane.withColumn("c", F.expr("z0 - a * x0 - b * y0")).select(*keys, "trial", "a", "b", "c"), "trials")
    votes = _votes(low, plane, keys, p.ground_residual)
    best = written(votes.groupBy(*keys).agg(F.max_by("trial", F.struct("n", -F.col("trial"))).alias("trial")), "best")
    best = written(plane.join(best, [*keys, "trial"]), "best")
    near = F.abs(F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"))) <= p.ground_residual
    mean = lambda u, v=None: F.avg(F.col(u) * F.col(v)) if v else F.avg(u)
    sums = band.join(best, keys).where(near).groupBy(*keys).agg(
        *(mean(a).alias(f"m{a}") for a in "xyz"), *(mean(*t).alias(f"m{t}") for t in ("xx", "xy", "yy", "xz", "yz"))
    )
    cov = {f"c{t}": F.col(f"m{t}") - F.col(f"m{t[0]}") * F.col(f"m{t[1]}") for t in ("xx", "xy", "yy", "xz", "yz")}
    sums = sums.withColumns(cov).withColumn("det", F.expr("cxx * cyy - cxy * cxy")).where("abs(det) > 1e-12")
    fit = sums.withColumn("a", F.expr("(cxz * cyy - cyz * cxy) / det")).withColumn("b", F.expr("(cyz * cxx - cxz * cxy) / det"))
    return fit.select(*keys, "a", "b", F.expr("mz - a * mx - b * my").alias("c"))


def with_ground(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """M1 and M2: ``is_ground``: not above the plane by more than the height; where no plane was found, near the lowest point."""
    plane = ground_planes(points, keys, p).select(*keys, *(F.col(c).alias(f"__{c}") for c in "abc"))
    both = with_cloud(points, keys, F.min("z").alias("__z")).join(plane, keys, "left")
    height = F.col("z") - (F.col("__a") * F.col("x") + F.col("__b") * F.col("y") + F.col("__c"))
    flat = F.col("z") <= F.col("__z") + p.fallback_height
    return both.withColumn("is_ground", F.coalesce(height <= p.ground_height, flat)).select(*points.columns, "is_ground")


def _core(own: DataFrame, keys: list[str], eps: float, min_samples: int) -> DataFrame:
    """Core points. In a cell of which any two points are near, ``min_samples`` points are core without a look at others."""
    small = [*keys, "gx", "gy", "gz"]
    full = own.groupBy(*small).agg(F.count("*").alias("__n")).withColumn("__full", F.col("__n") >= min_samples).drop("__n")
    marked = written(own.join(merged(full), small), "marked")
    open_ = marked.where("not __full").drop("__full")
    enough = radius_pairs(own, open_, keys, eps).groupBy(*keys, F.col("b").alias("point_id")).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_samples)
    return marked.where("__full").drop("__full").unionByName(open_.join(merged(enough.drop("__n")), [*keys, "point_id"], "left_semi"))


#: Links between cells that a task looks at together, and cells a side of a block of them.
LINKS, BLOCK = 100_000, 8


def _root(up: dict[int, int], n: int) -> int:
    while (m := up.get(n, n)) != n:
        up[n] = n = up.get(m, m)
    return n


def _spanning(links: DataFrame) -> DataFrame:
    """Of links ``a, b, sure`` what components need: of so many sure ones a spanning forest, and those not sure whose ends it leaves apart."""
    kind = to_arrow_schema(links.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def reduced() -> pa.RecordBatch:
            a, b, sure = (pa.chunked_array([h.column(c) for h in held]).to_pylist() for c in ("a", "b", "sure"))
            up: dict[int, int] = {}
            out, open_ = [], []
            for x, y, s in zip(a, b, sure, strict=True):
                if not s:
                    open_.append((x, y))
                elif (p := _root(up, x)) != (q := _root(up, y)):
                    up[p] = q
                    out.append((x, y, True))
            out += [(x, y, False) for x, y in open_ if _root(up, x) != _root(up, y)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], []), kind, strict=True)], schema=kind)

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= LINKS:
                yield reduced()
                held.clear()
        if held:
            yield reduced()

    return links.mapInArrow(run, links.schema)


def _labelled_cells(core: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """``node, label`` of cells, linked where a core point each are within ``eps``; a cell without links may be left out. Bounds of cells decide most pairs of cells, and
    most others are of cells that sure links join already; for the rest points of the first that are near the second's bounds look for one point of the
    second, and stop at the first they find.

    Cells meet in blocks: each in its own, and in those that hold cells up to two steps farther on."""
    here = ["gx", "gy", "gz"]
    box = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = written(core.groupBy(*keys, *here).agg(F.min("point_id").alias("node"), *box), "nodes")
    block = lambda c, by=0: F.floor((F.col(c) + by) / BLOCK).cast("long")
    one = cells.withColumns({f"__c{c}": block(f"g{c}") for c in "xyz"}).withColumnRenamed("node", "a")
    other = cells.select(*keys, *(F.col(f"g{c}").alias(f"t{c}") for c in "xyz"), F.col("node").alias("b"), *(F.col(f"{n}{c}").alias(f"{n}{c}2") for n in ("lo", "hi") for c in "xyz"))
    for c in "xyz":
        other = other.withColumn(f"__c{c}", F.explode(F.sequence(block(f"t{c}", -2), block(f"t{c}", 2))))
    pairs = one.join(merged(other), [*keys, *_CELLS]).where("a < b and " + " and ".join(f"abs(g{c} - t{c}) <= 2" for c in "xyz"))
    zero, sq = F.lit(0.0), lambda v: v * v
    gap = [sq(F.greatest(F.col(f"lo{c}2") - F.col(f"hi{c}"), F.col(f"lo{c}") - F.col(f"hi{c}2"), zero)) for c in "xyz"]
    reach = [sq(F.greatest(F.abs(F.col(f"hi{c}2") - F.col(f"lo{c}")), F.abs(F.col(f"hi{c}") - F.col(f"lo{c}2")))) for c in "xyz"]
    near = pairs.where(gap[0] + gap[1] + gap[2] <= eps * eps * 1.000001).select("a", "b", (reach[0] + reach[1] + reach[2] <= eps * eps * 0.999999).alias("sure"))
    near = written(_spanning(near), "cells")
    label = components(near.where("sure").select("a", "b"))
    open_ = near.where("not sure").select("a", "b")
    if open_.isEmpty():
        return label
    # pairs that other tasks' links join need no look either
    label = written(label, "sure")
    for end in "ab":
        open_ = open_.join(merged(label.withColumnsRenamed({"node": end, "label": f"__{end}"})), end, "left").withColumn(f"__{end}", F.coalesce(f"__{end}", end))
    open_ = open_.where("__a <> __b")
    mine = [F.col(c).alias(t) for c, t in zip(here, ["tx", "ty", "tz"], strict=True)]
    ends = open_.join(merged(cells.select(F.col("node").alias("a"), *keys, *here)), "a")
    ends = ends.join(merged(cells.select(F.col("node").alias("b"), *mine, *(F.col(f"{n}{c}").alias(f"{n}{c}2") for n in ("lo", "hi") for c in "xyz"))), "b")
    ask = ends.join(merged(core.select(*keys, *here, *(F.col(c).alias(f"p{c}") for c in "xyz"))), [*keys, *here])
    out = [sq(F.greatest(F.col(f"lo{c}2") - F.col(f"p{c}"), F.col(f"p{c}") - F.col(f"hi{c}2"), zero)) for c in "xyz"]
    there = ["tx", "ty", "tz"]
    ask = ask.where(out[0] + out[1] + out[2] <= eps * eps * 1.000001).select(*keys, *there, "__a", "__b", "px", "py", "pz").alias("l")
    answer = core.select(*keys, *mine, *(F.col(c).alias(f"q{c}") for c in "xyz")).alias("r")
    same = F.lit(True)
    for c in [*keys, *there]:
        same &= F.col(f"l.{c}") == F.col(f"r.{c}")
    found = ask.join(merged(answer), same & (square("p", "q") <= eps * eps), "left_semi")
    whole = components(found.select(F.col("__a").alias("a"), F.col("__b").alias("b"))).withColumnsRenamed({"node": "r", "label": "__label"})
    rooted = cells.select("node").join(merged(label), "node", "left").select("node", F.coalesce("label", "node").alias("r"))
    return rooted.join(merged(whole), "r", "left").select("node", F.coalesce("__label", "r").alias("label"))


def clusters(points: DataFrame, keys: list[str], eps: float, min_samples: int) -> DataFrame:
    """M3, DBSCAN: ``cluster_id`` of each point, -1 for noise; numbered from 0 in each cloud by least core id; a border point takes the lowest.

    Any two points of a cell of side eps / sqrt 3 are within ``eps``. So crowded cells are core as they are, cells, not points, are the nodes of the
    graph, and pairs of points are looked at only about points of cells that are not crowded. Points that are not finite are noise.
    """
    side = eps / 3**0.5 * 0.999999
    own = finite(points).select(*keys, "point_id", "x", "y", "z").withColumns({f"g{a}": F.floor(F.col(a) / side).cast("long") for a in "xyz"})
    small = [*keys, "gx", "gy", "gz"]
    core = written(_core(own, keys, eps, min_samples), "core")
    node = core.groupBy(*small).agg(F.min("point_id").alias("node"))
    named = node.join(merged(_labelled_cells(core, keys, eps)), "node", "left").select(*small, F.coalesce("label", "node").alias("label"))
    found = written(core.join(merged(named), small).select(*keys, "point_id", "x", "y", "z", "label"), "labelled")
    rest = own.join(merged(found.select(*keys, "point_id")), [*keys, "point_id"], "left_anti")
    at = lambda d, n, *more: d.select(*keys, F.col("point_id").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xyz"), *more)
    touch = cell_join(at(found, "a", "label"), at(rest, "b"), keys, eps)
    border = touch.groupBy(*keys, F.col("b").alias("point_id")).agg(F.min("label").alias("label"))
    every = found.select(*keys, "point_id", "label").unionByName(border)
    number = found.select(*keys, "label").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("label")) - 1)
    mine = every.join(merged(number), [*keys, "label"]).select(*keys, "point_id", "cluster_id")
    return points.join(merged(mine), [*keys, "point_id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def largest_cluster(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each cloud's largest cluster (the lowest of equals), or all points of a cloud that has none."""
    sizes = clustered.where("cluster_id >= 0").groupBy(*keys, "cluster_id").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*keys).agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("__best"))
    return clustered.join(best, keys, "left").where("__best is null or cluster_id = __best").drop("__best")


def with_vehicle(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """M4: ``cluster_id`` and ``is_vehicle``: the largest cluster off the ground, up to the vehicle height above the lowest point off the ground.

    The input is written once, as it is read by each round of the clustering."""
    points = written(points, "split")
    up = points.where("not is_ground")
    best = largest_cluster(clusters(up, keys, p.eps, p.min_samples), keys)
    low = written(up.groupBy(*keys).agg(F.min("z").alias("__z")), "lowest")
    hit = best.join(low, keys).where(F.col("z") <= F.col("__z") + p.vehicle_height).select(*keys, "point_id", "cluster_id")
    return points.join(merged(hit.withColumn("__hit", F.lit(True))), [*keys, "point_id"], "left").withColumn("is_vehicle", F.coalesce("__hit", F.lit(False))).drop("__hit")


def with_interior(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """``is_interior``: vehicle points in the seat band whose mean distance to their nearest is beyond the quantile; under ten, none."""
    own = points.where("is_vehicle")
    low = with_cloud(own, keys, F.min("z").alias("__z"))
    band = low.where((F.col("z") >= F.col("__z") + p.interior_low) & (F.col("z") <= F.col("__z") + p.interior_high))
    band = written(with_cloud(band.select(*keys, "point_id", "x", "y", "z"), keys, F.count("*").alias("__n")).where("__n >= 10").drop("__n"), "band")
    apart = k_nearest(band, band, keys, p.interior_k, whole=WHOLE).groupBy(*keys, "a").agg(F.avg(F.sqrt("d2")).alias("md"))
    apart = written(apart, "apart")
    limit = written(exact_quantiles(apart, keys, {"q": ("md", p.interior_quantile)}), "limits")
    hit = apart.join(limit, keys).where("md > q").select(*keys, F.col("a").alias("point_id"), F.lit(True).alias("__in"))
    return points.join(merged(hit), [*keys, "point_id"], "left").withColumn("is_interior", F.coalesce("__in", F.lit(False))).drop("__in")


_G = ["gx", "gy", "gz"]


def enclosed_voxels(occupied: DataFrame, keys: list[str], legacy: bool = False) -> DataFrame:
    """M6b, the documented intent: empty voxels with an occupied one on all six sides. ``legacy`` gives the literal result, which is empty.

    The ends of occupied lines along each axis are joined, in a slab of one gx first; so voxels come from lines that cross, and a stray point far
    away is one more line, not a row of empty voxels on the way to it.
    """
    cells = occupied.select(*keys, *_G).distinct()
    if legacy:
        return cells.limit(0)
    ends = lambda line, a: cells.groupBy(*keys, *line).agg(F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}")).where(f"hi_{a} - lo_{a} > 1")
    slab = ends(["gx", "gz"], "gy").join(merged(ends(["gx", "gy"], "gz")), [*keys, "gx"]).where("lo_gy < gy and gy < hi_gy and lo_gz < gz and gz < hi_gz")
    inner = slab.select(*keys, *_G).join(merged(ends(["gy", "gz"], "gx")), [*keys, "gy", "gz"]).where("lo_gx < gx and gx < hi_gx").select(*keys, *_G)
    return inner.join(merged(cells), [*keys, *_G], "left_anti")


def distance_map(voxels: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``keys, gx, gy, gz, distance``: steps along the axes to the nearest of some voxels, for all that are at most ``reach`` away, themselves included.

    One pass along each axis: a voxel's least distance so far goes to those beside it on the line as far as it can still matter, and the least is kept; so
    work is linear in ``reach`` for each axis.
    """
    now = voxels.select(*keys, *_G).distinct().withColumn("distance", F.lit(0))
    for a in _G:
        room = F.lit(reach) - F.col("distance")
        moved = now.withColumn("__s", F.explode(F.sequence(-room, room))).withColumns({a: F.col(a) + F.col("__s"), "distance": F.col("distance") + F.abs("__s")})
        now = moved.groupBy(*keys, *_G).agg(F.min("distance").alias("distance"))
    return now


def dilated(voxels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """All voxels within so many steps of one."""
    return distance_map(voxels, keys, times).select(*keys, *_G) if times else voxels.select(*keys, *_G).distinct()


def eroded(voxels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Voxels that have their six neighbours, so many times over: each is sent to itself and them, and those that come seven times are kept."""
    now = voxels.select(*keys, *_G).distinct()
    for _ in range(times):
        now = spread(now, _G, _around(1)).groupBy(*keys, *_G).agg(F.count("*").alias("__n")).where("__n = 7").select(*keys, *_G)
    return now


def opened(voxels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Without what is thinner than so many steps to either side."""
    return dilated(eroded(voxels, keys, times), keys, times) if times else voxels


def closed(voxels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """With what holes narrower than so many steps to either side let through."""
    return eroded(dilated(voxels, keys, times), keys, times) if times else voxels


def _around(reach: int) -> list[tuple[int, int, int]]:
    """Steps of at most ``reach`` voxels, along the axes."""
    r = range(-reach, reach + 1)
    return [(i, j, k) for i in r for j in r for k in r if abs(i) + abs(j) + abs(k) <= reach]


def void_voxels(occupied: DataFrame, keys: list[str], distance: int = 2, opening: int = 0, closing: int = 0) -> DataFrame:
    """Enclosed voxels that are at least ``distance`` steps from every occupied one. ``closing`` first shuts small holes in what is occupied, ``opening``
    then leaves out thin parts of the void."""
    shell = closed(occupied.select(*keys, *_G).distinct(), keys, closing)
    close = dilated(shell, keys, distance - 1)
    return opened(enclosed_voxels(shell, keys).join(merged(close), [*keys, *_G], "left_anti"), keys, opening)


def in_voxels(points: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Points (with ``gx, gy, gz``) whose voxel is in a set."""
    return points.join(merged(cells.select(*keys, "gx", "gy", "gz")), [*keys, "gx", "gy", "gz"], "left_semi")


def with_void_interior(points: DataFrame, keys: list[str], size: float = 0.1, distance: int = 2, opening: int = 0, closing: int = 0) -> DataFrame:
    """``is_interior``: points within ``distance`` voxels of the void that the cloud encloses, its inner surface and what stands there. Points that are
    not finite are not interior."""
    own = written(voxels(points, keys, size).select(*keys, "point_id", *_G), "voxels")
    near = dilated(void_voxels(own, keys, distance, opening, closing), keys, distance)
    hit = in_voxels(own, near, keys).select(*keys, "point_id", F.lit(True).alias("__in"))
    return points.join(merged(hit), [*keys, "point_id"], "left").withColumn("is_interior", F.coalesce("__in", F.lit(False))).drop("__in")


def orientation(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """Main axis and which end is the front, by dashboard points on either side of the middle; no row without a dashboard."""
    own = with_cloud(points, keys, F.min("z").alias("z_min"), *(f(a).alias(f"{a}_{n}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"))
    along_x = F.col("x_max") - F.col("x_min") > F.col("y_max") - F.col("y_min")
    v = F.when(along_x, F.col("x")).otherwise(F.col("y"))
    mid = F.when(along_x, (F.col("x_min") + F.col("x_max")) / 2).otherwise((F.col("y_min") + F.col("y_max")) / 2)
    dash = own.where((F.col("z") >= F.col("z_min") + 0.8) & (F.col("z") <= F.col("z_min") + 1.4))
    last = [F.first(c).alias(c) for c in ("z_min", "x_min", "x_max", "y_min", "y_max", "x_mean", "y_mean")]
    got = dash.groupBy(*keys).agg(F.first(along_x).alias("along_x"), F.count_if(v >= mid).alias("n_front"), F.count_if(v < mid).alias("n_rear"), *last)
    return got.withColumn("front_positive", F.col("n_front") > F.col("n_rear"))


def with_cockpit(points: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:  # noqa: B008
    """``is_cockpit``: interior points in the front part; all interior points of a cloud without a dashboard or where none would be left."""
    own = points.where("is_interior")
    o = orientation(own, keys, p)
    both = own.select(*keys, "point_id", "x", "y", "z").join(o, keys, "left")
    main, side = F.when(F.col("along_x"), F.col("x")).otherwise(F.col("y")), F.when(F.col("along_x"), F.col("y")).otherwise(F.col("x"))
    pick = lambda n: F.when(F.col("along_x"), F.col(f"x_{n}")).otherwise(F.col(f"y_{n}"))
    other = lambda n: F.when(F.col("along_x"), F.col(f"y_{n}")).otherwise(F.col(f"x_{n}"))
    length = pick("max") - pick("min")
    front = F.when(F.col("front_positive"), main >= pick("min") + 0.33 * length).otherwise(main <= pick("max") - 0.33 * length)
    near = F.abs(side - other("mean")) <= 0.35 * (other("max") - other("min"))
    tall = (F.col("z") >= F.col("z_min") + 0.6) & (F.col("z") <= F.col("z_min") + 1.6)
    marked = both.withColumn("__ok", F.coalesce(front & near & tall, F.lit(False)))
    some = written(marked.groupBy(*keys).agg(F.max("__ok").alias("__any")), "some")
    hit = marked.join(some, keys).where("__ok or not __any").select(*keys, "point_id", F.lit(True).alias("__hit"))
    return points.join(merged(hit), [*keys, "point_id"], "left").withColumn("is_cockpit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def _cut(points: DataFrame, keys: list[str], p: Params) -> DataFrame:
    return range_outliers(points, keys, p.outlier_quantile).drop("d", "d_max")


STEPS: list[tuple[str, Step]] = [("outliers", _cut), ("ground", with_ground), ("vehicle", with_vehicle), ("interior", with_interior), ("cockpit", with_cockpit)]


class ScenePipeline:
    """Named steps in order, each a function of (points, keys, params). An empty cloud passes through."""

    def __init__(self, steps: list[tuple[str, Step]] | None = None):
        self.steps = list(STEPS if steps is None else steps)

    def add_step(self, name: str, step: Step, at: int | None = None) -> ScenePipeline:
        self.steps.insert(len(self.steps) if at is None else at, (name, step))
        return self

    def remove_step(self, name: str) -> ScenePipeline:
        self.steps = [s for s in self.steps if s[0] != name]
        return self

    def run(self, points: DataFrame, keys: list[str], params: Params = Params()) -> DataFrame:  # noqa: B008
        """Each step's result is written to the shared folder, so a step is computed once and its size is known to the next one's plan."""
        for name, step in self.steps:
            points = written(step(points, keys, params), f"scene-{name}")
        return points
