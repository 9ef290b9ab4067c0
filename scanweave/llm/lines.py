"""Line dedup by site-relative frequency, in DataFrame functions alone.

Pages are grouped by host. A line is boilerplate on a host if it stands on at least ``min_pages`` of its pages and on more than ``ratio`` of them;
such lines are dropped from the host's pages. A page holds a line once however often it repeats it, so lines are made distinct inside their row
before anything is shuffled, and two 64-bit hashes stand for a line from there on. A host has at most (lines of a mean page / ratio) boilerplate
lines, whatever its pages, so one row holds them. That small table is written to the shared folder: the planner knows its size and broadcasts it
only below ``spark.sql.autoBroadcastJoinThreshold``; above, the join is a sort-merge join whose hot hosts are split at run time.

Defined cases: lines are compared without the white space around them; blank lines are never dropped nor counted; a null host is a host of its
own; a null text has no lines and stays null; very long texts are read whole; rows that repeat an id count as pages of their own; an empty table stays
empty; input columns named like a result are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inner_names, written

RATIO = 0.1
MIN_PAGES = 3

_trimmed = lambda x: F.trim(F.translate(x, "\r\t", "  "))


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: the marks of the boilerplate lines of each host that has any."""
    own = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _trimmed))
    each = own.select("host", F.explode(lines).alias("line")).where("line <> ''").select("host", _mark(F.col("line")).alias("line"))
    common = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    found = common.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    own_host, drop, own_kept = inner_names(docs, "host", "drop", "kept")
    found = written(boilerplate(docs, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias(own_host), F.col("lines").alias(drop))
    joined = docs.join(found, docs[host].eqNullSafe(found[own_host]), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(drop, _mark(_trimmed(x))))
    out = joined.withColumn(own_kept, F.when(F.col(drop).isNull(), lines).otherwise(kept))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    left = F.when(F.col(text).isNull(), 0).otherwise(F.size(own_kept))
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    return out.select(*rest, F.array_join(own_kept, "\n").alias(text), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"))
