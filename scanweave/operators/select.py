"""Order, first rows, samples and set operations within clouds and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered


def order_hash(column: str = "point_id", seed: int = 42) -> Column:
    """A fixed order without meaning, the same in any SQL engine."""
    return (F.col(column) % 1000003 * 7919 + seed * 104729) % 1000033


def _ranked(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n of each group; Spark limits each partition before the shuffle."""
    return _ranked(rows, keys, order).where(F.col("__r") <= n).drop("__r")


def stride(points: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Every n-th row of a scan. Numbers come from parts of a scan, so a large one is not one task."""
    return points if n <= 1 else numbered(points, keys, [order], "__r").where(F.col("__r") % n == 0).drop("__r")


def random_cap(points: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """T5: n rows of each group without replacement, in a seeded order that any SQL engine can tell."""
    return first_n(points, keys, [order_hash(id_col, seed), F.col(id_col)], n)


def uniform_sample(points: DataFrame, keys: list[str], order: str, target: int) -> DataFrame:
    """All of a small cloud, else every (n div target)-th, the first ``target`` of them."""
    n = points.groupBy(*keys).agg(F.count("*").alias("__n"))
    step = F.greatest(F.floor(F.col("__n") / target), F.lit(1))
    r = F.col("__r")
    hit = (F.col("__n") <= target) | ((r % step == 0) & (F.floor(r / step) < target))
    return numbered(points, keys, [order], "__r").join(n, keys).where(hit).drop("__r", "__n")


def best_model(tracks: DataFrame, keys: list[str], score: Column, min_detections: int = 2) -> DataFrame:
    """The track of the highest score in each group, the first of equals."""
    return first_n(tracks.where(F.col("n_detections") >= min_detections).withColumn("score", score), keys, [F.desc("score"), "track_id"], 1)


def concatenated(clouds: dict[str, DataFrame]) -> DataFrame:
    """Clouds one after another, with their names as ``source``."""
    out = None
    for name, cloud in clouds.items():
        one = cloud.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def combined(parts: DataFrame, keys: list[str], sums: list[str], lists: list[str] = ()) -> DataFrame:
    """Figures of parts of a cloud as one row: ``sums`` added, and ``lists`` as arrays in the order of the column ``part``."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(c).alias("v")))), lambda x: x["v"])
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(in_order(c).alias(c) for c in lists))


def without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose key b doesn't have."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")
