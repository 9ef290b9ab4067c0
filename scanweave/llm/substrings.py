"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one text; words are removed that lie in a window which also begins earlier. Of all places only those
are hashed whose number modulo ``PERIOD`` is in the ``COVER``, a set that has every difference modulo the period: whatever two places a repeated
window begins at, some place inside it is in the cover in both texts, at the same distance from the beginning, and leaves room for an anchor
of ``ANCHOR`` words. So a repeated window always shares an anchor, of which there are 4 for 13 words.

1. Texts that equal an earlier document's go as wholes, and take no part in what follows: whatever they hold begins earlier there.
2. Count anchors; keep those that occur twice or more (partial counts are combined before the shuffle). Semi-join the occurrences with them: places of
   a text where a repeat may lie. Only their lists by document and text are kept. A bitmap of bounded size spares shuffling most of the other anchors.
3. Extend: in those texts, hash each window around such a place with 96 bits; the least (document, place) of each hash is its first occurrence.
4. Windows that are not the first of their hash take their words away.

Hot anchors and windows are only ever counted, minimised or joined, never gathered; sort-merge joins split hot keys at run time. Texts are shuffled
twice, by a hash of document and text, so rows that share an id do not meet. Windows, first occurrences and places to remove are written to the
shared folder one after the other, so that the shuffle files of one step are gone before those of the next.

Defined cases: a null text has no words; a null id is less than any other; rows that share an id are one document for the order of places, and
windows at the same place of it are not earlier than one another; texts of fewer words than a window lose none; a column named like a result is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import NULL_ID, inner_names, map_bits, maybe_in, written

WINDOW, PERIOD = 20, 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of each anchor of texts that have a window at all."""
    w = W.words(column)
    doc = w.doc
    place = np.arange(len(doc)) - w.first[doc]
    n = np.diff(w.first)[doc]
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + ANCHOR <= n) & (n >= WINDOW))
    return W.range_hash(w.hashes(), at, at + ANCHOR, 1).view(np.int64), doc[at], place[at]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.pieces(batches):
        h, n = np.unique(_anchors(b.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _bitmap(often: DataFrame, bits: int) -> bytes:
    """A bit for each possible value of the first ``bits`` bits of an anchor's hash."""
    spot = F.shiftrightunsigned("h", 64 - bits)
    rows = often.groupBy(F.shiftright(spot, 15).alias("k")).agg(F.bitmap_construct_agg(spot.bitwiseAND(2**15 - 1)).alias("bits")).toLocalIterator()  # 4 kB a row
    out = bytearray(2 ** (bits - 3))
    for k, part in rows:
        out[k * 4096 : k * 4096 + len(part)] = part
    return bytes(out)


def _places(shared: Broadcast, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value, np.uint8)
        for b in W.pieces(batches):
            h, row, place = _anchors(b.column(0))
            spot = (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            some = often[spot >> 3] >> (spot & 7) & 1 == 1
            h, row, place = h[some], row[some], place[some]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(b.column(1).to_numpy()[row]), pa.array(place.astype(np.int32))], ["h", "row", "place"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows whose first columns are text, document, hash of the text and places of anchors: the windows about these places."""
    for b in W.pieces(batches):
        w, marks = W.words(b.column(0)), b.column(3)
        row = np.repeat(np.arange(b.num_rows), np.diff(marks.offsets.to_numpy()))
        at = marks.flatten().to_numpy()
        own = at + ANCHOR <= np.diff(w.first)[row]  # hashes of rows may collide
        row, at = row[own], at[own]
        # a window holds the anchor at most PERIOD - 1 words after its beginning
        step = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(step, w.first[row] + np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(step, w.first[row] + at + 1, -1)
        near = np.cumsum(step[:-1]) > 0
        start = W.window_starts(w, WINDOW)
        start = start[near[start]]
        doc = w.doc[start]
        a, b_ = (W.range_hash(w.hashes(s), start, start + WINDOW, s) for s in (2, 3))
        cols = [a.view(np.int64), (b_ >> np.uint64(32)).astype(np.uint32).view(np.int32), b.column(1).to_numpy()[doc], b.column(2).to_numpy()[doc], (start - w.first[doc]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "doc", "same", "place"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (all but the text if None), ``text`` with what is left of its words joined by spaces, ``n_words`` and ``n_removed``."""
    made = ("n_words", "n_removed", text)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    own_text, own_doc, own_same, own_row, own_places, own_of, own_at = inner_names(docs, "text", "doc", "same", "row", "places", "of", "at")
    row = lambda d, same: F.xxhash64(d, same)  # noqa: E731  of rows with equal texts only those with equal ids share it
    base = docs.select(F.col(text).cast("string").alias(own_text), doc.alias(own_doc), F.xxhash64(F.col(text).cast("string")).alias(own_same), *keep)
    base = base.withColumn(own_row, row(own_doc, own_same))

    same = [F.xxhash64("t").alias("t1"), F.xxhash64(F.lit(1), "t").alias("t2")]
    rows = docs.select(F.col(text).cast("string").alias("t"), doc.alias("doc")).where("t is not null").select("t", "doc", *same)
    least = rows.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("t1", "t2", "least")
    copies = written(rows.select("doc", "t1", "t2").join(least, ["t1", "t2"]).where("doc > least").select("doc", "t1", "t2").distinct(), "copies")
    key = F.xxhash64("doc", "t1", "t2").alias("key")
    judged = maybe_in(rows.select("*", key), "key", copies.select(key))
    own = judged.where("not maybe").select("t", row("doc", "t1").alias("row")).union(judged.where("maybe").join(copies.withColumn("copy", F.lit(True)), ["doc", "t1", "t2"], "left").where("copy is null").select("t", row("doc", "t1").alias("row")))

    often = written(own.select("t").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors", release=True)
    bits = map_bits(often.count())
    likely = docs.sparkSession.sparkContext.broadcast(_bitmap(often, bits))
    places = own.mapInArrow(_places(likely, bits), "h long, row long, place int").join(often, "h", "left_semi")
    marks = written(places.groupBy(F.col("row").alias(own_row)).agg(F.sort_array(F.collect_set("place")).alias(own_places)), "places", release=True)

    near = base.join(marks, own_row).select(own_text, own_doc, own_same, own_places)
    windows = written(near.mapInArrow(_windows, "a long, b int, doc long, same long, place int"), "windows", release=True)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("a", "b", "first"), "first", release=True)
    later = windows.join(first, ["a", "b"]).where(F.struct("doc", "place") > F.col("first"))
    whole = copies.select("doc", F.col("t1").alias("same"), F.lit(-1).alias("place"))
    gone = later.select("doc", "same", "place").union(whole).groupBy(row("doc", "same").alias(own_row)).agg(F.collect_set(F.struct("same", "place")).alias("gone"))
    gone = written(gone.select(own_row, F.col("gone.same").alias(own_of), F.col("gone.place").alias(own_at)), "gone", release=True)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = to_arrow_schema(schema)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, 0):
            kept, words, removed = [], [], []
            lists = zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)
            for raw, (same, of, at) in zip(b.column(0).cast(pa.binary()).to_pylist(), lists, strict=True):
                w = (raw or b"").split()  # at ASCII white space, as bytes do
                words.append(len(w))
                place = at.values.to_numpy()[of.values.to_numpy() == same] if at.is_valid else []
                if len(place) and place.min() < 0:  # a copy
                    w = w if len(w) < WINDOW else []
                elif len(place):
                    step = np.zeros(len(w) + 1, np.int64)
                    np.add.at(step, place, 1)
                    np.add.at(step, place + WINDOW, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                removed.append(words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words), pa.array(removed)], schema=out)

    return base.join(gone, own_row, "left").select(own_text, own_same, own_of, own_at, *keep).mapInArrow(strip, schema)
