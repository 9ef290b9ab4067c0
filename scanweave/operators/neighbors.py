"""Distance joins by grid cells: equal cells are joined, the exact distance is what is left to test; no nested loop, no Cartesian product."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scanweave.functions.scratch import written

from .order import exact_quantiles

_STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def cell(axis: str, r: float, shift: Column | int = 0) -> Column:
    return (F.floor(F.col(axis) / r) + shift).cast("long")


#: Coordinates from here on, in metres, are damage, as infinite ones are: numbers of their cells would not fit.
FARTHEST = 1e12


def finite(points: DataFrame) -> DataFrame:
    """Points whose coordinates are numbers below ``FARTHEST``; others are near nothing."""
    return points.where(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < {FARTHEST}D" for a in "xyz"))


def spread(rows: DataFrame, columns: list[str], steps: list[tuple[int, int, int]], names: list[str] | None = None) -> DataFrame:
    """Each row once for each step that its cell ``columns`` go, as ``names``."""
    s = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, "ijk", strict=True))) for t in steps))
    out = rows.withColumn("__s", F.explode(s))
    return out.withColumns({n: F.col(c) + F.col(f"__s.{a}") for n, c, a in zip(names or columns, columns, "ijk", strict=True)}).drop("__s")


def square(a: str, b: str) -> Column:
    """Squared distance of columns ``{a}x`` .. and ``{b}x`` .., added in the order x, y, z."""
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


_CELLS = ["__cx", "__cy", "__cz"]

#: Side of the cells of a distance join, in radii: a point is sent to two cells an axis at most. Sparse points may have larger ones, and fewer copies.
SIDE = 2.0


def merged(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is shuffled. The planner takes the bytes of files, or of compressed shuffles, for the size of what it would gather on the
    driver; rows that are sent to several cells, and columns of ids, are many times that."""
    return rows.hint("merge")


def placed(points: DataFrame, side: float | Column, axes: str = "xyz") -> DataFrame:
    """Points with the cell of ``side`` that each is in."""
    return points.withColumns({f"__c{a}": F.floor(F.col(a) / side).cast("long") for a in axes})


def sent(points: DataFrame, r: float | Column, side: float | Column, axes: str = "xyz") -> DataFrame:
    """Points once for each cell of ``side`` that may hold points within ``r`` of theirs: what lies between their coordinates less and plus ``r``.

    Rounding keeps order, and ``r`` is a little more than any distance that rounds to it; so no near point's cell is left out."""
    pad = r * (1 + 1e-12)
    for a in axes:
        low, high = (F.floor(v / side).cast("long") for v in (F.col(a) - pad, F.col(a) + pad))
        points = points.withColumn(f"__c{a}", F.explode(F.sequence(low, high)))
    return points


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], r: float, side: float = SIDE, how: str = "inner") -> DataFrame:
    """Rows of ``left`` (columns ``ax, ay, az`` and the like) beside those of ``right`` (``bx`` ..) within ``r``, both finite, by squared distance. ``left`` rows
    stay in one cell each, so what is grouped by ``keys``, ``_CELLS`` and more takes no further shuffle."""
    plain = lambda d, n: d.withColumns({a: F.col(f"{n}{a}") for a in "xyz"})
    own, other = placed(plain(left, "a"), side * r).drop(*"xyz"), sent(plain(right, "b"), r, side * r).drop(*"xyz")
    test = F.lit(True)
    for c in [*keys, *_CELLS]:
        test &= F.col(f"l.{c}") == F.col(f"r.{c}")
    d2 = square("a", "b")
    both = own.alias("l").join(merged(other).alias("r"), test & (d2 <= r * r), how)
    if how != "inner":
        return both
    return both.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in keys), d2.alias("d2"))


def _named(points: DataFrame, keys: list[str], id_col: str, out: str, *more: Column) -> DataFrame:
    return finite(points).select(*keys, F.col(id_col).alias(out), *(F.col(c).alias(f"{out}{c}") for c in "xyz"), *more)


def radius_pairs(left: DataFrame, right: DataFrame, keys: list[str], r: float, left_id: str = "point_id", right_id: str = "point_id") -> DataFrame:
    """``keys, a, b, d2`` for points within ``r`` of each other (both ends included), by squared distance. ``right``, the side to keep small, is
    sent to the eight cells that its points touch at most; points that are not finite are near nothing."""
    return cell_join(_named(left, keys, left_id, "a"), _named(right, keys, right_id, "b"), keys, r).select(*keys, "a", "b", "d2")


def own_pairs(points: DataFrame, keys: list[str], r: float) -> DataFrame:
    """J3 of one cloud with itself: ``keys, a, b, d2``, each pair once, the lesser id first."""
    return radius_pairs(points, points, keys, r).where("a < b")


#: Pairs of points of two cells that are looked at one by one, as a pair of cells costs about as much as some thousands of these; beyond it the cells are
#: halved, so many times at most.
FEW_PAIRS, HALVINGS = 65_536, 12


def _boxes(points: DataFrame, keys: list[str], side: float, name: str) -> DataFrame:
    """Cells of ``side`` that hold points: the cell as ``name``, how many points it holds, and their bounds."""
    at = F.struct(*(cell(a, side).alias(a) for a in "xyz")).alias(name)
    bounds = [f(a).alias(f"{name}{a}{n}") for a in "xyz" for f, n in ((F.min, 0), (F.max, 1))]
    return points.groupBy(*keys, at).agg(F.count("*").alias(f"{name}n"), *bounds)


def _judged(pairs: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Pairs of cells ``q``, ``c`` that may hold near points; ``inside`` tells that all of theirs are near, by the same sums as for points.

    Rounding keeps order, so bounds never say of two points what their own distance would not.
    """
    gap = {a: F.greatest(F.col(f"q{a}0") - F.col(f"c{a}1"), F.col(f"c{a}0") - F.col(f"q{a}1"), F.lit(0.0)) for a in "xyz"}
    reach = {a: F.greatest(F.col(f"q{a}1") - F.col(f"c{a}0"), F.col(f"c{a}1") - F.col(f"q{a}0")) for a in "xyz"}
    near, far = ((d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]) <= r * r for d in (gap, reach))
    return pairs.where(near).select(*keys, "q", "c", "qn", "cn", far.alias("inside"))


def cell_pairs(left: DataFrame, right: DataFrame, keys: list[str], r: float) -> tuple[DataFrame, DataFrame, int]:
    """Cells of ``left`` against cells of ``right``, of sides ``r / 2 ** level``: ``keys, level, q, n``, where all of ``n`` points are within ``r`` of all
    points of ``q``; ``keys, level, q, c``, pairs at the rim whose points are left to compare; and the number of levels. Each pair of points within ``r`` is
    in one of them once; at the rim of a table with itself, ``q`` is at most ``c``, and a pair stands for both of its orders.

    It begins with neighbouring cells of side ``r``. A pair of cells is settled by the bounds of their points, is left to compare if it has few pairs of
    points, and else goes on as the pairs of their halves, 64 at most. So where points are dense they are counted as cells, but for those at the rim.
    """
    once = left is right
    q, c = _boxes(left, keys, r, "q"), _boxes(right, keys, r, "c")
    steps = [t for t in _STEPS if t <= (0, 0, 0)] if once else _STEPS
    there = spread(c.withColumns({f"__c{a}": F.col(f"c.{a}") for a in "xyz"}), _CELLS, steps)
    pairs = q.withColumns({f"__c{a}": F.col(f"q.{a}") for a in "xyz"}).join(there, [*keys, *_CELLS])
    one, other = (F.struct(F.col(x).alias("q"), F.col(n).alias("n")) for x, n in (("q", "cn"), ("c", "qn")))
    ends = F.when(F.col("q") == F.col("c"), F.array(one)).otherwise(F.array(one, other)) if once else F.array(one)
    inside, rim = [], []
    for level in range(HALVINGS + 1):
        judged = written(_judged(pairs, keys, r), "cells")
        few = F.lit(level == HALVINGS) | (F.col("qn") * F.col("cn") <= FEW_PAIRS)
        of = F.lit(level).alias("level")
        inside.append(judged.where("inside").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, of, "e.q").agg(F.sum("e.n").alias("n")))
        rim.append(judged.where(~F.col("inside") & few).select(*keys, of, "q", "c"))
        open_ = judged.where(~F.col("inside") & ~few).select(*keys, F.col("q").alias("__q"), F.col("c").alias("__c"))
        if level == HALVINGS or open_.isEmpty():
            break
        half = r / 2 ** (level + 1)
        of_both = {n: F.struct(*(F.shiftright(f"{n}.{a}", 1).alias(a) for a in "xyz")) for n in "qc"}
        halves = {n: _boxes(p, keys, half, n).withColumn(f"__{n}", of_both[n]) for n, p in (("q", left), ("c", right))}
        pairs = open_.join(halves["q"], [*keys, "__q"]).join(halves["c"], [*keys, "__c"])
        if once:
            pairs = pairs.where("__q <> __c or q <= c")
    whole = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return whole(inside), whole(rim), len(rim)


def neighbour_counts(left: DataFrame, right: DataFrame, keys: list[str], r: float) -> DataFrame:
    """``keys, point_id, n``: how many points of ``right`` are within ``r`` (included) of a point of ``left``, where there are any; ids are distinct.

    Points in cells that are wholly within reach are counted by cells, others are compared one by one, a table with itself in one order; the counts are
    exact. What is shuffled are points, a few times each, cells, and pairs of cells; no cell, however crowded, is one task's. Points that are not finite are
    near nothing.
    """
    placed = lambda p, name: written(finite(p).select(*keys, "point_id", *"xyz"), name)
    own = placed(left, "asking")
    other = own if left is right else placed(right, "counted")
    inside, rim, levels = cell_pairs(own, other, keys, r)

    def at(points: DataFrame, name: str) -> DataFrame:
        points = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        side = F.lit(r) / F.pow(F.lit(2.0), F.col("level"))
        return points.withColumn(name, F.struct(*(F.floor(F.col(a) / side).cast("long").alias(a) for a in "xyz")))

    by_cell = at(own, "q").join(inside, [*keys, "level", "q"]).select(*keys, "point_id", "n")
    named = lambda points, cell_, x: at(points, cell_).withColumnsRenamed({"point_id": x} | {a: f"{x}{a}" for a in "xyz"})
    # few bytes, but much to compare: by a stated number, which the planner does not merge into one task
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = named(own, "q", "a").join(rim, [*keys, "level", "q"]).repartition(tasks, *keys, "level", "c")
    both = asked.join(named(other, "c", "b"), [*keys, "level", "c"])
    ends = F.array("a")
    if left is right:
        both = both.where("q <> c or a <= b")
        ends = F.when(F.col("a") == F.col("b"), ends).otherwise(F.array("a", "b"))
    near = both.where(square("a", "b") <= r * r).select(*keys, F.explode(ends).alias("point_id"))
    by_point = near.groupBy(*keys, "point_id").agg(F.count("*").alias("n"))
    return by_cell.unionByName(by_point).groupBy(*keys, "point_id").agg(F.sum("n").alias("n"))


def local_density(points: DataFrame, keys: list[str], r: float) -> DataFrame:
    """Neighbours within ``r``, the point itself included."""
    near = neighbour_counts(points, points, keys, r)
    return finite(points).select(*keys, "point_id").join(merged(near), [*keys, "point_id"], "left").select(*keys, "point_id", F.coalesce("n", F.lit(1)).alias("neighbours"))


#: Sides of the cells that points are counted in, as powers of two: 3 cm to 64 m.
LEVELS = (-5, 6)


def _level_cells(points: DataFrame) -> DataFrame:
    """Points with the cell of side ``2 ** __m`` that each is in."""
    return placed(points, F.pow(F.lit(2.0), F.col("__m")))


def _with_level(queries: DataFrame, points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Queries with ``__m``: ``2 ** __m`` is a radius that likely holds ``k`` points and not many times as many about the query.

    Points are counted in cells of all levels, which is a table of adaptive cells: the one of a query is the smallest around it that holds ``k``. Queries
    look at levels from the first that has such cells to the first where these hold all points.
    """
    every = F.explode(F.sequence(F.lit(LEVELS[0]), F.lit(LEVELS[1])))
    counted = _level_cells(points.select(*keys, *"xyz").withColumn("__m", every)).groupBy(*keys, "__m", *_CELLS).agg(F.count("*").alias("__n"))
    full = written(counted.where(F.col("__n") >= k), "full")
    held, total = {m: n for m, n in full.groupBy("__m").agg(F.sum("__n")).collect()}, points.count()  # a dozen levels
    whole = [m for m, n in held.items() if n == total]
    used = sorted(m for m in held if not whole or m <= min(whole))
    if not used:
        return queries.withColumn("__m", F.lit(LEVELS[1] + 1))
    own = _level_cells(queries.select(*keys, "point_id", *"xyz").withColumn("__m", F.explode(F.lit(used).cast("array<int>")))).join(merged(full), [*keys, "__m", *_CELLS])
    least = own.groupBy(*keys, "point_id").agg(F.min(F.col("__m") * F.lit(1 << 48) + F.least("__n", F.lit(4 * k))).alias("__l"))
    m, n = F.floor(F.col("__l") / F.lit(1 << 48)).cast("int"), F.pmod(F.col("__l"), F.lit(1 << 48))
    level = F.when(n < 4 * k, m).otherwise(m - 1)
    return queries.join(merged(least), [*keys, "point_id"], "left").withColumn("__m", F.coalesce(level, F.lit(LEVELS[1] + 1))).drop("__l")


def _near(points: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, a, b, d2`` for queries and the points within ``2 ** __m`` of each, by cells of twice that side."""
    used = [r[0] for r in left.select("__m").distinct().collect()]  # a few dozen at most
    r = F.pow(F.lit(2.0), F.col("__m"))
    there = placed(points.select(*keys, F.col("point_id").alias("b"), *"xyz").withColumn("__m", F.explode(F.lit(used).cast("array<int>"))), SIDE * r)
    there = there.withColumnsRenamed({a: f"b{a}" for a in "xyz"})
    here = sent(left.select(*keys, F.col("point_id").alias("a"), "__m", *"xyz"), r, SIDE * r).withColumnsRenamed({a: f"a{a}" for a in "xyz"})
    both = there.join(merged(here), [*keys, "__m", *_CELLS]).withColumn("d2", square("a", "b"))
    return both.where(F.col("d2") <= F.pow(F.lit(4.0), F.col("__m"))).select(*keys, "a", "b", "d2")


#: Points of a cloud that queries are compared with at once, queries that a task compares at once, and those that it holds distances of. Larger clouds go by cells.
WHOLE, ASKED, DISTANCES = 2_048, 2_048, 128


def _in_small(queries: DataFrame, points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys, a, b, d2, rank`` in clouds of at most ``WHOLE`` points: such a cloud is one row of arrays, which meets its queries as arrays of about ``ASKED``
    each; so points are shuffled once, and neither copies of them nor pairs that are not of the nearest leave a task. A table with itself is shuffled once."""
    once = queries is points
    gathered = lambda d, names, *by: d.groupBy(*keys, *by).agg(*(F.collect_list(c).alias(n) for c, n in zip(("point_id", *"xyz"), names, strict=True)))
    there, here = ["b", "bx", "by", "bz"], ["a", "ax", "ay", "az"]
    both = gathered(points, there)
    if once:
        here = there
    else:
        counted = queries.join(merged(queries.groupBy(*keys).agg(F.count("*").alias("__q"))), keys)
        both = gathered(counted, here, F.pmod(F.xxhash64("point_id"), F.ceil(F.col("__q") / ASKED)).alias("__part")).join(merged(both), keys)
    id_type = {n: d.schema["point_id"].dataType for n, d in (("a", queries), ("b", points))}
    made = T.StructType([*(points.schema[c] for c in keys), *(T.StructField(n, t) for n, t in id_type.items()), T.StructField("d2", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    kind = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in range(rows.num_rows):
                b, *p = (rows.column(c)[r].values for c in there)
                order = np.argsort(b.to_numpy(zero_copy_only=False), kind="stable")  # so equals stand in the order of ids
                b, p = b.take(pa.array(order)), [v.to_numpy()[order] for v in p]
                a, *q = (rows.column(c)[r].values for c in here)
                q = [v.to_numpy() for v in q]
                want = min(k, len(b))
                for at in range(0, len(a), DISTANCES):
                    d = [u[at : at + DISTANCES, None] - v[None, :] for u, v in zip(q, p, strict=True)]
                    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                    one, other = np.nonzero(d2 <= np.partition(d2, want - 1, axis=1)[:, want - 1 : want])
                    near = d2[one, other]
                    order = np.lexsort((other, near, one))
                    one, other, near = one[order], other[order], near[order]
                    rank = np.arange(len(one)) - np.searchsorted(one, one) + 1
                    one, other, near, rank = (v[rank <= want] for v in (one, other, near, rank))
                    own = [rows.column(c).take(pa.array(np.full(len(one), r))) for c in keys]
                    found = [a.take(pa.array(one + at)), b.take(pa.array(other)), pa.array(near), pa.array(rank, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *(v.cast(f.type) for v, f in zip(found, list(kind)[len(keys) :], strict=True))], schema=kind)

    return both.select(*keys, *dict.fromkeys([*here, *there])).mapInArrow(run, made)


def k_nearest(queries: DataFrame, points: DataFrame, keys: list[str], k: int, start: float | None = None, rounds: int = 16, whole: int = 0) -> DataFrame:
    """``keys, a, b, d2, rank`` of the k nearest points (all, in a smaller cloud), ties by id; a point counts as its own neighbour.

    In clouds of at most ``whole`` points (``WHOLE`` at most) each query is compared with all of them; what follows is for larger ones. Each query searches a radius of its own, led by the density about it unless ``start`` gives one for all; so a cloud with dense and sparse parts takes
    no more rounds, and no more pairs, than an even one. Queries that are certain (k hits, or the whole cloud) are kept, and the rest go on at four times
    the radius. Points that are not finite neither find others nor are found.
    """
    once = queries is points
    points = written(finite(points).select(*keys, "point_id", *"xyz"), "points")
    asked = points if once else finite(queries).select(*keys, "point_id", *"xyz")
    done = None
    if whole := min(whole, WHOLE):
        sizes = written(points.groupBy(*keys).agg(F.count("*").alias("__n")), "sizes")
        few, many = sizes.where(F.col("__n") <= whole), sizes.where(F.col("__n") > whole)
        only = many.isEmpty()
        of_few = lambda d: d if only else d.join(merged(few), keys, "left_semi")
        small = of_few(points)
        done = _in_small(small if once else of_few(asked), small, keys, k)
        if only:
            return done
        points = written(points.join(merged(many), keys, "left_semi"), "points")
    size = points.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias("__want"))
    asked = asked.join(size.select(*keys), keys, "left_semi")
    left = written(_with_level(asked, points, keys, k) if start is None else asked.withColumn("__m", F.lit(math.ceil(math.log2(start)))), "left")
    for _ in range(rounds):
        near = _near(points, left, keys)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("d2", "b"))).where(F.col("rank") <= k)
        enough = ranked.groupBy(*keys, "a").agg(F.count("*").alias("n")).join(size, keys).where("n >= __want").select(*keys, "a")
        got = written(ranked.join(merged(enough), [*keys, "a"], "left_semi"), "nearest")
        done = got if done is None else done.unionByName(got)
        left = left.join(merged(got.where("rank = 1").select(*keys, F.col("a").alias("point_id"))), [*keys, "point_id"], "left_anti")
        left = written(left.withColumn("__m", F.col("__m") + 2), "left")
        if left.isEmpty():
            return done
    raise RuntimeError(f"points too far apart for {rounds} rounds; begin with a larger radius")


def merge_new(existing: DataFrame, new: DataFrame, keys: list[str], distance: float = 0.05) -> DataFrame:
    """Existing points and the new ones farther than ``distance`` from all of them; new points aren't compared with each other."""
    near = radius_pairs(existing, new, keys, distance).select(*keys, F.col("b").alias("point_id")).distinct()
    return existing.unionByName(new.join(merged(near), [*keys, "point_id"], "left_anti"))


def nearest_places(points: DataFrame, scans: DataFrame, keys: list[str], scan: str, r: float, side: float = SIDE) -> DataFrame:
    """J6 with the cell that each point is in: ``keys, _CELLS, a, scan, b, nx, ny, nz``."""
    pairs = cell_join(_named(points, keys, "point_id", "a"), _named(scans, keys, "point_id", "b", F.col(scan)), keys, r, side)
    best = F.min(F.struct("d2", "b", *(F.col(f"b{c}").alias(f"n{c}") for c in "xyz"))).alias("best")
    return pairs.groupBy(*keys, *_CELLS, "a", scan).agg(best).select(*keys, *_CELLS, "a", scan, "best.b", *(f"best.n{c}" for c in "xyz"))


def nearest_in_each(points: DataFrame, scans: DataFrame, keys: list[str], scan: str, r: float) -> DataFrame:
    """For each point and scan the nearest scan point within ``r``: ``keys, a, scan, b, nx, ny, nz``."""
    return nearest_places(points, scans, keys, scan, r).drop(*_CELLS)


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], size: float = 2.0) -> DataFrame:
    """Points and the boxes that hold them, for any number of boxes. Boxes are sent to the cells that they touch in x and y, and joined by cell;
    cells double in side until a box touches three a side at most, so each box goes to nine cells of its own size at most."""
    shared = [k for k in keys if k in boxes.columns]
    ok = boxes.where("x_min <= x_max and y_min <= y_max and z_min <= z_max and not isnan(x_max) and not isnan(y_max) and not isnan(z_max)")
    width = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), F.lit(size))
    ok = ok.withColumn("__level", F.greatest(F.ceil(F.log2(width / (2 * size))), F.lit(0)).cast("int"))
    ok = ok.withColumn("__side", size * F.pow(F.lit(2.0), F.col("__level")))
    levels = [r[0] for r in ok.select("__level").distinct().collect()]  # a few dozen at most
    span = lambda a: F.sequence(F.floor(F.col(f"{a}_min") / F.col("__side")), F.floor(F.col(f"{a}_max") / F.col("__side")))
    sent = ok.withColumn("__cx", F.explode(span("x"))).withColumn("__cy", F.explode(span("y"))).drop("__side")
    side = F.lit(size) * F.pow(F.lit(2.0), F.col("__level"))
    own = points.withColumn("__level", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumns({"__cx": F.floor(F.col("x") / side), "__cy": F.floor(F.col("y") / side)})
    inside = "x >= x_min and x <= x_max and y >= y_min and y <= y_max and z >= z_min and z <= z_max"
    return own.join(sent, [*shared, "__level", "__cx", "__cy"]).where(inside).select(*points.columns, "box_id")


def statistical_outliers(points: DataFrame, keys: list[str], k: int = 20, sigmas: float = 2.0) -> DataFrame:
    """M5: points whose mean distance to their k neighbours is at most the cloud's mean plus so many deviations."""
    near = written(k_nearest(points, points, keys, k + 1, whole=WHOLE).where("a <> b").groupBy(*keys, "a").agg(F.avg(F.sqrt("d2")).alias("md")), "apart")
    limit = written(near.groupBy(*keys).agg((F.avg("md") + sigmas * F.stddev_pop("md")).alias("limit")), "limits")
    kept = near.join(limit, keys).where("md <= limit").select(*keys, F.col("a").alias("point_id"), "md")
    return points.join(merged(kept), [*keys, "point_id"])


def median_outliers(points: DataFrame, keys: list[str], sigmas: float = 2.0) -> DataFrame:
    """Inside each detection, points near its median; fewer than three points are left alone."""
    mid = exact_quantiles(points, keys, {f"m{a}": (a, 0.5) for a in "xyz"}).join(points.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    far = points.join(mid, keys).withColumn("md", F.sqrt(sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "yz"), start=(F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")))))
    limit = far.groupBy(*keys).agg((F.avg("md") + sigmas * F.stddev_pop("md")).alias("limit"))
    return far.join(limit, keys).where("n < 3 or md <= limit").select(*points.columns)
