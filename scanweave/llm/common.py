"""What the corpus operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions.scratch import clear_shared, shared_dir, written
from scanweave.operators.graph import components

__all__ = ["MAP_MB", "NULL_ID", "bounded_batches", "clear_shared", "components", "inner_names", "map_bits", "maybe_in", "partitions", "shared_dir", "table", "written"]

#: Stands for a null id inside an operator, where ids are compared; it sorts before every other.
NULL_ID = -(2**63)


#: Rows, and bytes of them, that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 32_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python in small batches, each of which executor and worker hold, by number and by bytes.

    A session that has set less keeps its own. The settings stay: a plan reads them when it runs, which is after the operator has returned.
    """
    for name, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):  # a session gives its number of bytes with a unit
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(name).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
        if not 0 < now <= most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def inner_names(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that no column of ``df`` has."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


#: A bitmap that is broadcast takes at most so many megabytes, and at least half of one.
MAP_MB = 32


def map_bits(members: int) -> int:
    """Bits of a bitmap for so many members, as a power of two: eight for each, within the bounds."""
    return min(max((8 * members).bit_length(), 22), (MAP_MB << 23).bit_length() - 1)


def maybe_in(rows: DataFrame, key: str, members: DataFrame, flag: str = "maybe") -> DataFrame:
    """``rows`` with the column ``flag``: false where ``key`` is surely not in the one column of ``members``, a table that is cheap to count.

    A bitmap of the size that ``map_bits`` gives is broadcast; it only spares shuffles, and an exact join has to follow (inner or left: the optimizer
    moves semi and anti joins before the test).
    """
    parts = 1 << (map_bits(members.count()) - 15)
    part, at, bits, byte = inner_names(rows, "part", "at", "bits", "byte")
    spot = lambda c: F.xxhash64(c)
    bucket, place = lambda c: F.pmod(spot(c), F.lit(parts)), lambda c: F.pmod(F.shiftright(spot(c), 20), F.lit(32768))
    name = members.columns[0]
    maps = members.groupBy(bucket(name).alias(part)).agg(F.bitmap_construct_agg(place(name)).alias(bits))
    own = rows.withColumns({part: bucket(key), at: place(key)}).join(F.broadcast(maps), part, "left")
    own = own.withColumn(byte, F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int"))
    return own.withColumn(flag, F.coalesce(F.expr(f"shiftright({byte}, CAST({at} % 8 AS INT)) & 1 = 1"), F.lit(False))).select(*rows.columns, flag)
