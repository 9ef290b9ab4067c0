"""Row numbers and exact quantiles inside groups of any size: no group is held in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.scratch import written

def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "r") -> DataFrame:
    """``rows`` with ``name``, their number from 0 in each group by ``order``, which names columns that tell its rows apart.

    Rows are parted by ranges of keys and order, and written with the number of their part; each part is numbered by itself, from where the group's
    parts before it end.
    """
    parted = rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    parted = written(parted, "parted")
    sizes = parted.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.withColumn("__first", before).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    return parted.withColumn("__own", own).join(first, [*keys, "__part"]).withColumn(name, F.col("__first") + F.col("__own")).drop("__part", "__own", "__first")


#: Bits of a value that the rounds of the search look at, from the highest on.
_SHIFTS = (51, 38, 25, 12, 0)


def double_order(value: Column) -> Column:
    """A long for each double that is a number, in the same order: the bits of its size, negated for negative ones; both zeros are 0.

    The exponent comes from a logarithm, mended by comparison with powers of two; what is left divides by one of them without rounding.
    """
    a = F.abs(value)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.greatest(guess - F.when(a < power(guess), 1).otherwise(0) + F.when((guess < 1023) & (a >= power(guess + 1)), 1).otherwise(0), F.lit(-1022))
    whole = F.shiftleft((exponent + 1023).cast("long"), 52) + ((a / power(exponent) - 1) * float(2**52)).cast("long")
    half = float(2**537)
    size = F.when(a == float("inf"), F.lit(0x7FF << 52)).when(a < float(2**-1022), (a * half * half).cast("long")).otherwise(whole)
    return F.when(value < 0, -size).otherwise(size)


def exact_quantiles(rows: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]]) -> DataFrame:
    """``keys`` and for each name in ``quantiles`` the quantile of a column, between neighbours in proportion. Nulls and NaN do not count; infinities are
    the greatest and least of values, and stand for themselves where a quantile falls on one, or between one and a number. A group without values has
    null.

    A radix search: each round counts the values that agree with the wanted one in the bits before by their next 13 bits, in order of the doubles.
    So there are five rounds at most, whatever the values, a task holds 8,192 counts of a group at most, and counts are combined before the shuffle. The
    columns are read together, and written once.
    """
    group = [*keys, "__name"]
    value = lambda c: F.col(c).cast("double")
    each = F.array(*(F.struct(F.lit(n).alias("n"), value(c).alias("v")) for n, (c, _) in quantiles.items()))
    own = rows.select(*keys, F.explode(each).alias("__e")).select(*keys, F.col("__e.n").alias("__name"), F.col("__e.v").alias("__v")).where("__v is not null and not isnan(__v)")
    own = written(own.withColumn("__k", double_order(F.col("__v"))), "values")
    wanted = F.create_map(*(F.lit(x) for n, (_, q) in quantiles.items() for x in (n, float(q))))
    rank = wanted[F.col("__name")] * (F.col("__n") - 1)
    whole = own.groupBy(*group).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    start = whole.withColumns({"__rank": F.floor(rank), "__part": rank - F.floor(rank), "__prefix": F.lit(0).cast("long"), "__c": F.col("__n")}).drop("__n")
    state = written(start, "ranks")
    done = None
    for before, shift in zip((None, *_SHIFTS), _SHIFTS, strict=False):
        settled, left = state.where("__lo = __hi"), state.where("__lo < __hi")
        done = settled if done is None else done.unionByName(settled)
        if not left.head():
            break
        near = own.join(left.select(*group, "__prefix"), group)
        near = near.where(F.shiftright("__k", before) == F.col("__prefix")) if before is not None else near
        counts = near.groupBy(*group, F.shiftright("__k", shift).alias("__b")).agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = counts.withColumn("__u", F.sum("__c").over(Window.partitionBy(*group).orderBy("__b"))).join(left.select(*group, "__rank", "__part"), group)
        hit = upto.where("__u > __rank").groupBy(*group).agg(F.min(F.struct("__b", "__u", "__c", "__lo", "__hi", "__rank", "__part")).alias("__h"))
        inside = F.col("__h.__rank") - F.col("__h.__u") + F.col("__h.__c")
        state = written(hit.select(*group, inside.alias("__rank"), F.col("__h.__b").alias("__prefix"), *(F.col(f"__h.{c}").alias(c) for c in ("__lo", "__hi", "__c", "__part"))), "ranks")
    else:
        done = done.unionByName(state)
    # the next value is the same one, unless this is the last of its kind
    done = written(done.select(*group, F.col("__lo").alias("__a"), (F.col("__part") > 0) & (F.col("__rank") + 1 >= F.col("__c")), "__part").toDF(*group, "__a", "__last", "__part"), "found")
    above = own.join(done.where("__last").select(*group, "__a"), group).where("__v > __a").groupBy(*group).agg(F.min("__v").alias("__next"))
    both = done.join(above, group, "left")
    a, z, part = F.col("__a"), F.coalesce("__next", "__a"), F.col("__part")
    between = F.when((a == z) | (F.abs(a) == float("inf")), a).when(F.abs(z - a) == float("inf"), a * (1 - part) + z * part).otherwise(a + part * (z - a))
    out = both.select(*keys, "__name", between.alias("__q")).groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in quantiles))
    return rows.select(*keys).distinct().join(out, keys, "left") if keys else out
