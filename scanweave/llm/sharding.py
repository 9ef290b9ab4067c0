"""K-d tree sharding: recursive splits at weighted medians until leaves reach the target bytes.

Rows are points in a space of metadata (bytes, characters, language), weighted by their bytes. All nodes of a level are split at once. A level
takes one grouped pass for the extents, which gives each node its widest dimension, and a radix search for the weighted median along it: each
pass sums bytes by node and digit, at most 2**13 sums a node, whatever the number of rows. A row's place along a dimension ends in a hash of its
text, so rows of equal text have equal places and a cut takes them together, unless that would unbalance the halves; then the cut goes on by a
hash of the id inside that text.

Nodes, sums and cuts stay in tables, a row for each node of a level, that rows are joined with; the planner broadcasts them below its threshold. So
the number of leaves is not bounded by the driver, which reads one number, the sum of all bytes. Every ``REWRITE`` levels the rows are written with
the node they have reached. Nothing is sorted as a whole, gathered or sampled.

Defined cases: a null text has no bytes, a row's size is its bytes plus 1; nulls in a dimension count as its least value; rows that agree in
everything may be divided arbitrarily between neighbouring slots but stay in one shard; very long texts weigh what they weigh, so one may fill a
leaf; an empty table has no shards; input columns are not passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

DIGIT, DIGITS = 13, 4
_KEY_BITS = DIGIT * DIGITS
_PLACE_BITS = 20
#: A cut may miss a node's middle by this share of a leaf to keep equal texts together.
TOLERANCE = 0.01
#: Levels after which rows are written with their nodes.
REWRITE = 2
#: Rows that one task numbers.
SLOT_ROWS = 200_000


def _points(docs: DataFrame, id_col: str, text_col: str, dims: list[Column]) -> DataFrame:
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"),
        F.shiftrightunsigned(F.xxhash64(id_col), 64 - _KEY_BITS).alias("ki"), *(d.cast("double").alias(f"d{k}") for k, d in enumerate(dims)),
    )
    own = written(own, "points")
    ends = own.agg(*(f(f"d{k}") for k in range(len(dims)) for f in (F.min, F.max))).first()
    low = F.shiftrightunsigned("h", 64 - _KEY_BITS + _PLACE_BITS)
    for k in range(len(dims)):
        lo, hi = (ends[2 * k] or 0.0), (ends[2 * k + 1] or 0.0)
        place = F.coalesce((F.col(f"d{k}") - lo) / (hi - lo), F.lit(0.0)) if hi > lo else F.lit(0.0)
        own = own.withColumn(f"k{k}", F.shiftleft((place * (2**_PLACE_BITS - 1)).cast("long"), _KEY_BITS - _PLACE_BITS).bitwiseOR(low))
    return own


def _medians(points: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """For each row of ``state`` (``node, half, below`` and others): ``value``, the value of ``key`` at which the node's bytes reach ``half``, the bytes
    ``below`` it, added to those given, and ``at`` it."""
    now = state.withColumns({"value": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    for d in range(DIGITS):
        shift = _KEY_BITS - DIGIT * (d + 1)
        near = points.join(now.select("node", "value"), "node").where(F.shiftrightunsigned(key, shift + DIGIT) == F.col("value"))
        sums = near.groupBy("node", F.shiftrightunsigned(key, shift).bitwiseAND(2**DIGIT - 1).alias("x")).agg(F.sum("size").alias("s"))
        upto = sums.withColumn("c", F.sum("s").over(Window.partitionBy("node").orderBy("x"))).join(now.select("node", "half", "below"), "node")
        digit = F.struct("x", "c", "s")
        best = upto.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("below") + F.col("c") >= F.col("half"), digit)), F.max(digit)).alias("d"))
        new = {
            "value": F.shiftleft("value", DIGIT).bitwiseOR(F.col("d.x")),
            "below": F.col("below") + F.col("d.c") - F.col("d.s"),
            "at": F.col("d.s"),
        }
        now = written(now.join(best, "node").withColumns(new).drop("d"), "medians")
    return now


def _cuts(points: DataFrame, dims: int, slack: float) -> DataFrame:
    """``node, dim, value, inner`` of each node in ``points``: left of the cut is a key below ``value``, or equal to it and the id's hash at most ``inner``."""
    keys = [f"k{k}" for k in range(dims)]
    stats = points.groupBy("node").agg(F.sum("size").alias("total"), *((F.max(k) - F.min(k)).alias(k) for k in keys))
    widest = F.array_position(F.array(*keys), F.greatest(*keys, F.lit(0))) - 1 if dims > 1 else F.lit(0)
    nodes = written(stats.select("node", widest.cast("int").alias("dim"), (F.col("total") / 2).alias("half"), F.lit(0).cast("long").alias("below")), "nodes")
    along = points.join(nodes.select("node", "dim"), "node").withColumn("key", F.element_at(F.array(*keys), F.col("dim") + 1))
    found = _medians(along, nodes, "key")
    before, after = F.abs(F.col("half") - F.col("below")), F.abs(F.col("below") + F.col("at") - F.col("half"))
    inner = F.when(before < after, -1).otherwise(2**_KEY_BITS).cast("long")
    even = found.withColumns({"inner": inner, "coarse": F.least(before, after) > slack})
    inside = even.where("coarse").select("node", "dim", F.col("value").alias("outer"), "half", "below")
    if inside.isEmpty():
        return even.select("node", "dim", "value", "inner")
    equal = along.join(inside.select("node", "outer"), "node").where("key = outer")
    split = _medians(equal, inside, "ki").select("node", "dim", F.col("outer").alias("value"), F.when(before < after, F.col("value") - 1).otherwise(F.col("value")).alias("inner"))
    return even.where("not coarse").select("node", "dim", "value", "inner").unionByName(split)


def kd_tree(docs: DataFrame, leaves: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: list[Column] | None = None, target_bytes: int | None = None) -> DataFrame:
    """``id, size, crc, shard`` of each row. ``leaves`` is a power of two; with ``target_bytes``, the least at which no leaf is to hold more."""
    if dims is None:
        dims = [F.log2(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1), F.log2(F.coalesce(F.length(text_col), F.lit(0)) + 1), F.crc32(F.col("lang").cast("binary"))]
    points = _points(docs, id_col, text_col, dims).withColumn("node", F.lit(1).cast("long"))
    total = points.agg(F.sum("size")).first()[0] or 1
    if target_bytes:
        leaves = 1 << max(0, -(-total // target_bytes) - 1).bit_length()
    keys = F.array(*(f"k{k}" for k in range(len(dims))))
    for level in range(leaves.bit_length() - 1):
        cuts = written(_cuts(points, len(dims), TOLERANCE * total / leaves), "cuts")
        key = F.element_at(keys, F.col("dim") + 1)
        left = (key < F.col("value")) | ((key == F.col("value")) & (F.col("ki") <= F.col("inner")))
        points = points.join(cuts, "node").withColumn("node", 2 * F.col("node") + F.when(left, 0).otherwise(1)).drop("dim", "value", "inner")
        if level % REWRITE == REWRITE - 1:
            points = written(points, "placed")
    return points.select("id", "size", "crc", (F.col("node") - leaves).cast("int").alias("shard"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """With ``slot``, gapless from 0 in each shard. Rows are written with a number of their own and, by its hash, dealt to parts of bounded size, rows that
    repeat an id and text, too; each part is numbered from where the parts before end."""
    own = written(sharded.withColumn("u", F.monotonically_increasing_id()), "sharded")
    parts = own.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("parts"))
    own = own.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).drop("parts")
    sizes = own.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    numbered = own.withColumn("r", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "u")) - 1)
    return numbered.join(first, ["shard", "part"]).select(*sharded.columns, (F.col("first") + F.col("r")).cast("long").alias("slot"))
