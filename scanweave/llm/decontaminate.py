"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of ``window`` consecutive words (an item of fewer words, but not none, is one window). A window is held by a
text if all its shingles stand there in place: containment 1. For that threshold one shingle of each window is a necessary prefix, so shingles
are ordered by how often they occur in the documents, and each window joins on its rarest one only. The place of the shingle in the window fixes
where the window would begin (positional bound), that it must end inside the text is the length bound, and what is left is verified word by word. Equal windows of items are found by 128 bits of hash.

Items, long ones in parts that overlap by a window less a word, are taken in blocks of about ``BLOCK_BYTES``; each is a broadcast of bounded size and
two passes over the documents, which are never shuffled. One block is held at a time: before the next one is fetched, the pass is written to the
shared folder and the broadcast goes.

Defined cases: null and empty texts have no words and hits none; an item with no words has no window; a null item id counts as the empty string;
items that share an id count once, repeated items are taken once; windows that several items share count for each; repeated rows get a result each; very long texts are judged
whole; an empty table has no rows, and no items no hits; a document column with the name of a result is replaced by it, others are kept whatever
their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import inner_names, written

#: Words of a shingle; a window of fewer words is its own shingle.
SHINGLE = 5
#: Bytes of item text in a block, which takes some seventy times that while it is made, and words of a part of a long item.
BLOCK_BYTES, PART_WORDS = 4_000_000, 100_000

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


class Block:
    """The distinct windows of some items as places in their words, who owns them, and, once ranked, the prefix of each window. All of it is arrays: a
    window takes some dozens of bytes, whatever its words."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        w = W.words(texts, W.ALNUM, lower=True)
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < window))
        at = np.concatenate((W.window_starts(w, window), w.first[short]))
        item = np.searchsorted(w.first, at, "right") - 1
        length = np.minimum(n[item], window)
        mark = [W.range_hash(w.hashes(seed), at, at + length, seed + 1) for seed in (2, 4)]
        order = np.lexsort((item, *mark))
        at, item, length, mark = at[order], item[order], length[order], [m[order] for m in mark]
        new = np.ones(len(at), bool)
        new[1:] = (mark[0][1:] != mark[0][:-1]) | (mark[1][1:] != mark[1][:-1])
        #: The first place of each window among the items' words, its length, and where its owners begin.
        self.words, self.at, self.lengths = w, at[new], length[new]
        self.ids = ["" if k is None else k for k in ids]
        self.owner, self.owned = item.astype(np.int32), np.append(np.flatnonzero(new), len(at))
        self.sizes = sorted(set(np.minimum(self.lengths, SHINGLE).tolist()))
        hashes = w.hashes()
        self.shingle = {size: np.zeros(0, np.uint64) for size in self.sizes}
        for size in self.sizes:
            some = np.arange(max(0, len(w.start) - size + 1))
            self.shingle[size] = W.range_hash(hashes, some, some + size, 1)
        inside = [self.shingle[size][self.at[k] + j] for size in self.sizes for k in [np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)] for j in range(int(self.lengths[k].max()) - size + 1) for k in [k[self.lengths[k] - size >= j]]]
        self.keys = np.unique(np.concatenate([np.unique(x) for x in inside])) if inside else np.zeros(0, np.uint64)

    def rank(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle; a window whose rarest one never occurs needs no join at all."""
        often = np.zeros(len(self.keys), np.int64)
        often[np.searchsorted(self.keys, keys.view(np.uint64))] = counts
        best = np.full(len(self.at), np.iinfo(np.int64).max)
        key, offset = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        for size in self.sizes:
            of = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == size)
            for j in range(int(self.lengths[of].max()) - size + 1):
                k = of[self.lengths[of] - size >= j]
                mine = np.searchsorted(self.keys, self.shingle[size][self.at[k] + j])
                less = (often[mine] < best[k]) | (often[mine] == best[k]) & (mine < key[k])
                best[k[less]], key[k[less]], offset[k[less]] = often[mine][less], mine[less], j
        kept = np.flatnonzero((best > 0) & (best < np.iinfo(np.int64).max))
        kept = kept[np.argsort(key[kept], kind="stable")]
        self.window_of, self.offset = kept, offset[kept]
        self.keys, self.begin = self.keys[np.unique(key[kept])], np.append(np.unique(key[kept], return_index=True)[1], len(kept))
        self.shingle = {}

    def text(self, window: int) -> list[bytes]:
        return [self.words.text(i) for i in range(self.at[window], self.at[window] + self.lengths[window])]

    def items(self, window: int) -> list[str]:
        return [self.ids[k] for k in self.owner[self.owned[window] : self.owned[window + 1]]]

    def found(self, w: W.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words at which a shingle of this block begins, and which key it is."""
        if not len(self.keys) or not len(w.start):
            return
        hashes = w.hashes()
        for size in self.sizes:
            at = W.window_starts(w, size)
            h = W.range_hash(hashes, at, at + size, 1)
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            ok = self.keys[k] == h
            yield at[ok], k[ok]


def _count(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        total = np.zeros(len(block.keys), np.int64)
        for batch in W.pieces(batches):
            w = W.words(batch.column(0), W.ALNUM, lower=True)
            for _, k in block.found(w):
                total += np.bincount(k, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    return run


def _mark(shared: Broadcast, n_keep: int, first: bool, schema: pa.Schema):
    """Rows of a text, spans and items of the blocks before (but for the first), and ``n_keep`` columns to pass on."""

    def hits(w: W.Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Verified occurrences: first word, window."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, k in block.found(w):
            n = block.begin[k + 1] - block.begin[k]
            place = np.repeat(at, n)
            entry = np.repeat(block.begin[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window = block.window_of[entry]
            start, length = place - block.offset[entry], block.lengths[window]
            doc = np.searchsorted(w.first, place, "right") - 1
            ok = (start >= w.first[doc]) & (start + length <= w.first[doc + 1])
            ok[ok] = [[w.text(i) for i in range(s, s + n)] == block.text(x) for s, n, x in zip(start[ok].tolist(), length[ok].tolist(), window[ok].tolist(), strict=True)]
            starts.append(start[ok])
            windows.append(window[ok])
        return np.concatenate(starts), np.concatenate(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in W.pieces(batches, 0):
            w = W.words(batch.column(0), W.ALNUM, lower=True)
            start, window = hits(w, block)
            doc = np.searchsorted(w.first, start, "right") - 1
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + block.lengths[window], -1)
            hit = np.cumsum(step[:-1]) > 0
            items: dict[int, set[str]] = defaultdict(set)
            for d, x in set(zip(doc.tolist(), window.tolist(), strict=True)):
                items[d].update(block.items(x))
            spans, names = [], []
            before, owned = ([[]] * batch.num_rows,) * 2 if first else (batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for d, (old, had) in enumerate(zip(before, owned, strict=True)):
                a, b = w.first[d], w.first[d + 1]
                if d not in items:
                    spans.append(old)
                    names.append(had)
                    continue
                for s, e in zip(old[::2], old[1::2], strict=True):
                    hit[a + s : a + e] = True
                edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
                spans.append(np.flatnonzero(edge).astype(np.int32))
                names.append(sorted({*had, *items[d]}))
            n_hit = [int(np.sum(np.asarray(s[1::2], np.int64)) - np.sum(np.asarray(s[::2], np.int64))) for s in spans]
            made = [pa.array(np.diff(w.first)), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[batch.num_columns - n_keep :], *made], schema=schema)

    return run


def _parts(window: int, part_words: int):
    """Items of more than ``part_words`` words as parts that together have the same windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, 1):
            w = W.words(batch.column(1), W.ALNUM, lower=True)
            rows, texts = [], []
            for k in range(batch.num_rows):
                a, b = int(w.first[k]), int(w.first[k + 1])
                for i in range(a, max(a + 1, b - window + 1), part_words) if b > a else ():
                    rows.append(k)
                    texts.append(w.data[w.start[i] : w.end[min(b, i + part_words + window - 1) - 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])

    return run


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS) -> Iterator[tuple[Block, bool]]:
    """Each block when it is asked for, and whether it is the last."""
    own = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    own = own.mapInArrow(_parts(window, part_words), "id string, text string")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()
        yield Block(rows.column(0).to_pylist(), rows.column(1), window), k == n - 1


def benchmark_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS,
) -> DataFrame:
    """``keep`` of ``docs`` (all its columns if None) with ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``hit_spans``
    (begin, end, begin, end ... in words) and ``hit_items`` (ids of the items concerned, as strings)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    (own_text,) = inner_names(docs, "text")
    passed = T.StructType([T.StructField(own_text, T.StringType()), *(docs.schema[c] for c in keep)])
    now = docs.select(F.col(text).cast("string").alias(own_text), *keep)
    for k, (block, last) in enumerate(item_blocks(items, item_id, item_text, window, block_bytes, part_words)):
        shared = spark.sparkContext.broadcast(block)
        counts = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_count(shared), "shingle long, n long")
        often = counts.groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()  # at most the shingles of a block, two numbers each
        block.rank(*(c.to_numpy() for c in often.columns))
        shared.unpersist()
        shared = spark.sparkContext.broadcast(block)
        left = list(passed)[1:] if last else list(passed)
        schema = T.StructType([*left, *RESULT])
        before = [] if k == 0 else ["hit_spans", "hit_items"]
        read = now.select(F.col(own_text).alias(f"{own_text}_"), *before, *(f.name for f in left))
        now = read.mapInArrow(_mark(shared, len(left), k == 0, to_arrow_schema(schema)), schema)
        if not last:
            now = written(now, "hits")
            shared.unpersist()
    return now


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with the columns of ``docs``."""
    return benchmark_hits(docs, items, **options).where("n_hit = 0").select(*docs.columns)
