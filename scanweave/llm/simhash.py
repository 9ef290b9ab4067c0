"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are taken over all three-word shingles of a text, repeats included: a bit is one if it is set in over half of the shingles' XXH64. The
distinct fingerprints are dealt to tiles by their population counts, of the whole and, as more of them come, of two, four, eight or sixteen equal
parts of it (``parts_for``). Fingerprints of two tiles differ in at least as many bits as the tiles' counts do, so tile pairs beyond the radius in sum
are skipped unseen; all others are compared, each fingerprint with each, by exclusive-or and bit counts over numpy blocks of bounded size. A crowded
tile is split into blocks, pairs of which go to tasks of their own. Nothing is estimated: every link within the radius is found.

Of the links of two blocks a spanning forest is enough, as what is asked for is components; so a group of near copies is not spelt out as pairs.
Components come from these links between distinct fingerprints; documents are only joined to them at the end, by fingerprint.

Defined cases: null and empty texts, and those without words, have fingerprint zero and are linked like any other; a text of one or two words is
hashed as a whole; repeated rows are rows; ties do not arise; a null id is never the smallest, and a component of null ids alone has none; long texts
are hashed in stretches; an empty table has no rows; kept columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from . import words as W
from .common import components, inner_names, partitions, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a block, two of which are compared in one go, and those of the first that meet the second at once.
TILE, STRIP = 2048, 256
#: Shingles that are hashed at once.
STRETCH = 200_000


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - SHINGLE + 1)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        some = words[at : min(at + STRETCH, n) + SHINGLE - 1]
        shingles = zip(*(some[k:] for k in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [some]
        h = np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprinted(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "simhash") -> DataFrame:
    """``keep`` of ``docs`` and ``name``, the fingerprint as a signed long."""
    keep = docs.columns if keep is None else keep
    (t,) = inner_names(docs, "t")
    out = T.StructType([*(docs.schema[k] for k in keep), T.StructField(name, T.LongType())])
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in W.pieces(batches, t):
            marks = np.array([fingerprint(x) for x in p.column(t).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*p.columns[:-1], pa.array(marks)], schema=kind)

    return docs.select(*keep, F.col(text).cast("string").alias(t)).mapInArrow(run, out)


def parts_for(n: int, tile: int = TILE) -> int:
    """Parts whose counts name a tile: the fewest with which the fullest tile of ``n`` even fingerprints has at most ``tile``."""
    for parts in (1, 2, 4, 8, 16):
        bits = 64 // parts
        if n * (comb(bits, bits // 2) / 2**bits) ** parts <= tile:
            break
    return parts


def _tile(mark: Column, parts: int) -> Column:
    """The population counts of the parts as digits of one number; a digit has room for the radius on both sides."""
    bits = 64 // parts
    base, out = bits + 2 * RADIUS + 1, F.lit(0).cast("long")
    for k in range(parts):
        part = mark if parts == 1 else F.shiftrightunsigned(mark, k * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out = out + F.bit_count(part).cast("long") * F.lit(base**k).cast("long")
    return out


def _steps(parts: int) -> list[int]:
    """From a tile to those whose counts differ by the radius in sum at most, one way of each."""
    base = 64 // parts + 2 * RADIUS + 1
    found = {0}
    for k in range(1, RADIUS + 1):
        for places in product(range(parts), repeat=k):
            for signs in product((-1, 1), repeat=k):
                found.add(sum(s * base**p for s, p in zip(signs, places, strict=True)))
    return sorted(d for d in found if d >= 0)


def _forest(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links within the radius that join what is not joined yet."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := up.get(v, v)) != v:
            up[v] = up.get(p, p)
            v = p
        return v

    a, b = [], []
    for at in range(0, len(x), STRIP):
        i, j = np.nonzero(np.bitwise_count(x[at : at + STRIP, None] ^ y[None, :]) <= radius)
        for u, v in zip(x[at + i].tolist(), y[j].tolist(), strict=True):
            if u != v and (ru := root(u)) != (rv := root(v)):
                up[rv] = ru
                a.append(u)
                b.append(v)
    return a, b


def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            x, y = (b.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
            one, other = (np.array(v, np.uint64).view(np.int64) for v in _forest(x, y, radius))
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])


def links(marks: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """``a, b``: links that join all fingerprints within the radius, of ``n`` distinct ones in the column ``mark``."""
    parts = parts_for(n, tile)
    own = marks.select("mark", _tile(F.col("mark"), parts).alias("tile"))
    sizes = own.groupBy("tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    block = own.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int"))
    block = written(block.groupBy("tile", "block").agg(F.collect_list("mark").alias("marks")), "tiles")
    to = F.explode(F.array(*(F.lit(d).cast("long") for d in _steps(parts))))
    asks = block.select("tile", F.col("block").alias("i"), to.alias("step")).withColumn("there", F.col("tile") + F.col("step"))
    asks = asks.join(sizes.select(F.col("tile").alias("there"), "blocks"), "there").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = asks.where("step > 0 or i <= j").select("tile", "i", "there", "j")
    left = asks.join(block.select("tile", F.col("block").alias("i"), F.col("marks").alias("x")), ["tile", "i"])
    both = left.join(block.select(F.col("tile").alias("there"), F.col("block").alias("j"), F.col("marks").alias("y")), ["there", "j"])
    dealt = both.repartition(partitions(marks.sparkSession), "tile", "i", "there", "j").select("x", "y")
    return dealt.mapInArrow(lambda b: _compared(b, RADIUS), "a long, b long")


def with_component(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """``keep`` of ``docs`` (all if None), ``fingerprint`` in hexadecimal digits, and ``component_id``, the smallest id reachable by links."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("fingerprint", "component_id")]
    mark, number, label, found = inner_names(docs, "mark", "number", "label", "found")
    own = written(fingerprinted(docs.withColumn(number, F.col(id_col).cast("long")), text, [*keep, number], mark), "fingerprints")
    marks = written(own.groupBy(F.col(mark).alias("mark")).agg(F.min(number).alias("least")), "marks")
    joined = components(written(links(marks, marks.count(), tile), "links"))
    named = marks.join(joined.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "least", F.coalesce("label", "mark").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.select(F.col("mark").alias(found), "label").join(least, "label").select(found, "component_id")
    both = own.join(of, F.col(mark) == F.col(found))
    return both.select(*keep, F.lower(F.lpad(F.hex(mark), 16, "0")).alias("fingerprint"), "component_id")
