"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes, and in how many documents.

Tokens of a text by A and by B are cut into groups at the byte offsets where tokens of both end. All A-B pairs of a group are links; the count of a
pair of ids is the number of documents that hold it linked.

1. Texts are tokenized once; the ids are written. From there on documents are aligned from their ids, again in every pass, which is cheap.
2. A first pass gives the distinct pairs. They are parted by ranges of A's ids, so a part has no more than ``RANGE`` times B's ids, and each part is
   given a minimal perfect hash: bit arrays of twice the keys that are left, in which a key that meets no other has its bit; those that meet go on
   to the next array. The rank of a key's bit, over all parts, is its index. The keys themselves are kept by index and compared at each look-up.
3. The pass that counts: each task adds to a dense vector by that index, and vectors are summed as a tree, ``FAN`` tasks at a time, part by part.
4. The second pass over documents looks counts up by the same hash.

What tasks need of the hash is broadcast in rounds of parts that take ``ROUND_BYTES`` at most, which is tested; with more pairs there are more rounds,
each of which aligns the documents again and adds to their sums. Nothing is dropped.

Defined cases: null and empty texts, and those that either tokenizer does not give back byte for byte, have no tokens and zeros; repeated rows are
documents of their own; ties for an id's highest count all count; very long texts are aligned whole, their links made in bounded stretches; an empty
table has no rows; kept columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import inner_names, partitions, written
from .packing import Tokens

#: Ids of A in a part of the pairs, vectors that are summed at once, bytes of the hash and counts that are broadcast at once.
RANGE, FAN, ROUND_BYTES = 64, 16, 128_000_000
#: Links that are made at once, and bytes of text that are tokenized at once.
LINKS, SLICE = 2_000_000, 2_000_000

RESULT = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])


class Pieces(Tokens):
    """Ids by a sentence-piece model, as ``Tokens``: texts are parted before a space that follows another character, as no piece of the model goes over
    such a place; a model that has such a piece, or that does not take texts as they are, gets them whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        own = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        names = [p.piece for p in own.pieces]
        self.names, self.bytes = names, [self.model.is_byte(k) for k in range(len(names))]
        norm = own.normalizer_spec
        as_it_is = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not own.trainer_spec.treat_whitespace_as_suffix
        self.usual = as_it_is and not any(a != "▁" and b == "▁" for n in names for a, b in zip(n, n[1:], strict=False))
        self.known, self.before, self.special = {}, {}, []

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(data) + 1, bool)
        if self.usual:
            begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        begins[offsets] = True
        return np.flatnonzero(begins[:-1])

    def _fresh(self, new: list[str]) -> dict[str, bytes]:
        """The model puts a space before a text, but not before an empty one, so the one that a piece begins with is left out."""
        found = {p: array("I", ids).tobytes() for p, ids in zip(new, self.model.encode([p[1:] for p in new], num_threads=1), strict=True)}
        return found | ({" ": array("I", [self.model.piece_to_id("▁")]).tobytes()} if " " in found else {})


@dataclass
class Table:
    """Bytes of a tokenizer's tokens by id, and their decimal numbers."""

    store: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    digits: np.ndarray
    shown: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Table:
        size = np.array([len(t) for t in tokens], np.int64)
        width = len(str(len(tokens)))
        text = [str(k).rjust(width) + "," for k in range(len(tokens))]
        digits = np.frombuffer("".join(text).encode(), np.uint8).reshape(-1, width + 1).copy()
        return Table(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size, digits, digits != 32)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another."""
        n = self.size[ids]
        stop = np.cumsum(n)
        return self.store[np.arange(stop[-1] if len(n) else 0) + np.repeat(self.begin[ids] - stop + n, n)]


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others for 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(2)
def _tools(a_file: str, b_file: str) -> tuple[Tokens, Pieces, Table, Table]:
    """One set for all tasks of a worker."""
    a, b, byte = Tokens(a_file, plain=True), Pieces(b_file), _byte_of()
    vocabulary = a.tool.get_vocab(with_added_tokens=True)
    own = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        own[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    other = [bytes([int(n[3:-1], 16)]) if is_byte else n.replace("▁", " ").encode() for n, is_byte in zip(b.names, b.bytes, strict=True)]
    return a, b, Table.of(own), Table.of(other)


def _spaced(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts with a space before them, the empty ones left empty; their bytes, and where each begins."""
    some = pc.fill_null(column.cast(pa.string()), "")
    texts = pc.if_else(pc.greater(pc.binary_length(some), 0), pc.binary_join_element_wise(pa.scalar(" "), some, pa.scalar("")), pa.scalar(""))
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return texts, data, offsets - offsets[0]


def _same(ids: np.ndarray, n: np.ndarray, table: Table, data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which texts their tokens give back byte for byte."""
    of_token = np.append(0, np.cumsum(table.size[ids]))
    bounds = of_token[np.append(0, np.cumsum(n))]
    ok = np.diff(bounds) == np.diff(first)
    if ok.all():
        bad = table.joined(ids) != data
        wrong = np.append(0, np.cumsum(bad))
        return np.diff(wrong[first]) == 0
    got = table.joined(ids)
    for k in np.flatnonzero(ok):
        ok[k] = np.array_equal(got[bounds[k] : bounds[k + 1]], data[first[k] : first[k + 1]])
    return ok


def _split(ids: np.ndarray, n: np.ndarray, ok: np.ndarray, kind: str) -> pa.Array:
    raw, at = ids.astype(kind).tobytes(), np.append(0, np.cumsum(n)) * np.dtype(kind).itemsize
    return pa.array([raw[i:j] if good else b"" for i, j, good in zip(at.tolist(), at[1:].tolist(), ok.tolist(), strict=False)], pa.binary())


def tokenized(docs: DataFrame, a_file: str, b_file: str, text: str, keep: list[str], names: tuple[str, str, str]) -> DataFrame:
    """``keep``, a number for each row, and the ids of both tokenizers, four bytes each."""
    number, a_name, b_name = names
    own = docs.select(*keep, F.col(text).cast("string").alias(a_name))
    out = T.StructType([*own.select(*keep).schema, T.StructField(a_name, T.BinaryType()), T.StructField(b_name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_table, b_table = _tools(a_file, b_file)
        for p in W.pieces(batches, a_name, SLICE):
            texts, data, first = _spaced(p.column(a_name))
            (ia, na), (ib, nb) = a.of(texts), b.of(texts)
            ok = _same(ia, na, a_table, data, first) & _same(ib, nb, b_table, data, first)
            yield pa.RecordBatch.from_arrays([*p.columns[:-1], _split(ia, na, ok, "<u4"), _split(ib, nb, ok, "<u4")], names=out.names)

    return own.mapInArrow(run, out).withColumn(number, F.monotonically_increasing_id())


@dataclass
class Aligned:
    """Tokens of a batch of documents, one after another, with their groups; ``first_*`` tell where a document's begin."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_group: np.ndarray

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        n = int(self.first_group[-1])
        return np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)


def aligned(a: pa.Array, b: pa.Array, a_table: Table, b_table: Table) -> Aligned:
    read = lambda c: (np.frombuffer(b"".join(c.to_pylist()), "<u4").astype(np.int64), np.append(0, np.cumsum(pc.binary_length(c).to_numpy(False) // 4)))
    (ia, first_a), (ib, first_b) = read(a), read(b)
    end_a, end_b = np.cumsum(a_table.size[ia]), np.cumsum(b_table.size[ib])
    total = int(end_a[-1]) if len(end_a) else 0
    at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    at_a[end_a], at_b[end_b] = True, True
    groups = np.cumsum(at_a & at_b, dtype=np.int64)  # that have ended at each byte
    return Aligned(ia, ib, first_a, first_b, groups[end_a - 1], groups[end_b - 1], groups[np.append(0, end_a)[first_a]])


def links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Document and pair of ids (A's in the high half) of all links, in stretches of about ``LINKS``; whether a stretch ends with its last document."""
    if not len(x.a):
        return
    size_b = x.sizes[1]
    begin_b = np.cumsum(size_b) - size_b
    times = size_b[x.group_a]
    upto = np.cumsum(times)
    doc = np.repeat(np.arange(len(x.first_a) - 1), np.diff(x.first_a))
    ends = np.append(0, upto)[x.first_a]  # links before each document
    at = 0
    while at < len(x.a):
        done = upto[at - 1] if at else 0
        k = int(np.searchsorted(ends, done + LINKS, "right")) - 1
        stop = int(x.first_a[k])
        if stop <= at:  # a document of more links than a stretch
            stop = max(at + 1, min(int(np.searchsorted(upto, done + LINKS, "right")), int(x.first_a[doc[at] + 1])))
        n = times[at:stop]
        total = int(n.sum())
        place = np.arange(total) + np.repeat(begin_b[x.group_a[at:stop]] - np.cumsum(n) + n, n)
        yield np.repeat(doc[at:stop], n), np.repeat(x.a[at:stop] << 32, n) | x.b[place], bool((x.first_a == stop).any())
        at = stop


def _unique(doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) and how often each is there."""
    small = pair >> 32 << 16 | pair & 0xFFFF
    if doc[-1] - doc[0] < 1 << 30 and pair.max() < 1 << 48 and (pair & 0xFFFFFFFF).max() < 1 << 16:
        both, n = np.unique((doc - doc[0]) << 32 | small, return_counts=True)
        return (both >> 32) + doc[0], (both >> 16 & 0xFFFF) << 32 | both & 0xFFFF, n
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))
    at = np.flatnonzero(new)
    return doc[at], pair[at], np.diff(np.append(at, len(doc)))


def distinct_links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (document, pair) with their numbers, each document's in one stretch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for doc, pair, whole in links(x):
        held.append(_unique(doc, pair))
        if whole:
            if len(held) == 1:
                yield held[0]
            else:  # one document, in several stretches
                pairs, inverse = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
                yield np.full(len(pairs), held[0][0][0]), pairs, np.bincount(inverse, np.concatenate([h[2] for h in held])).astype(np.int64)
            held = []


def _place(keys: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    """Where keys fall in a bit array of a level."""
    h = W.mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return ((h >> np.uint64(32)) * size.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def perfect(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes and bits of the arrays of a minimal perfect hash of distinct keys, and the keys by index."""
    sizes, bits, left = [], [], keys
    placed: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = _place(left, len(sizes), np.full(1, size))
        alone = np.bincount(at, minlength=size) == 1
        ok = alone[at]
        placed.append((base + at[ok], left[ok]))
        sizes.append(size)
        bits.append(alone)
        left, base = left[~ok], base + size
    where, key = (np.concatenate(c) for c in zip(*placed, strict=True))
    return sizes, np.concatenate(bits), key[np.argsort(where)]


class Index:
    """The hashes of a round of parts as one: an index for each of its keys, without gaps."""

    def __init__(self, parts: list[tuple[int, list[int], bytes, bytes]]):
        levels = max((len(s) for _, s, _, _ in parts), default=1)
        self.part = np.array([p for p, *_ in parts], np.int64)
        self.size = np.zeros((len(parts), levels), np.int64)
        for k, (_, s, _, _) in enumerate(parts):
            self.size[k, : len(s)] = s
        self.start = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        self.bits = np.frombuffer(b"".join(b for _, _, b, _ in parts), np.uint64)
        ones = np.bitwise_count(self.bits)
        self.rank = np.cumsum(ones) - ones
        self.keys = np.frombuffer(b"".join(k for *_, k in parts), np.int64)
        #: Where the keys of each part begin.
        self.first = np.append(0, np.cumsum([len(k) // 8 for *_, k in parts]))
        self.slot = np.full(int(self.part.max()) + 1 if len(parts) else 1, -1)
        self.slot[self.part] = np.arange(len(parts))

    def mine(self, keys: np.ndarray) -> np.ndarray:
        """Keys whose part is of this round."""
        part = (keys >> 32) // RANGE
        return (part < len(self.slot)) & (self.slot[np.minimum(part, len(self.slot) - 1)] >= 0)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, all of which have to be known."""
        part = self.slot[(keys >> 32) // RANGE]
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            if not len(left):
                break
            k, p = keys[left], part[left]
            at = self.start[p, level] + _place(k, level, self.size[p, level])
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            bits = self.bits[word]
            hit = (self.size[p, level] > 0) & (bits >> bit & np.uint64(1)).astype(bool)
            low = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.rank[word] + low)[hit]
            left = left[~hit]
        if len(left) or not np.array_equal(self.keys[out], keys):
            raise ValueError("a pair of ids that the first pass has not seen")
        return out


def _by_part(batches: Iterator[pa.RecordBatch], make: Callable[[int, list], tuple], schema: pa.Schema, keys: int = 1) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows that agree in their first ``keys`` columns, made from the last column's values."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, make(*now, held), strict=True))], schema=schema)

    for b in batches:
        columns = [b.column(k).to_pylist() for k in range(keys)]
        for k, key in enumerate(zip(*columns, strict=True)):
            if key != now:
                if held:
                    yield row()
                now, held = key, []
            held.append(b.column(keys)[k].as_py())
    if held:
        yield row()


def _pairs(tokens: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """``pair``: those that documents link, each once or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, a_table, b_table = _tools(a_file, b_file)
        seen = np.zeros(0, np.int64)
        for p in W.pieces(batches, 0, SLICE):
            found = [np.unique(pair) for _, pair, _ in links(aligned(p.column(0), p.column(1), a_table, b_table))]
            seen = np.unique(np.concatenate([seen, *found])) if found else seen
            if len(seen) > LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(seen)], ["pair"])
                seen = np.zeros(0, np.int64)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen)], ["pair"])

    return tokens.mapInArrow(run, "pair long")


def _hashes(pairs: DataFrame) -> DataFrame:
    """``part, n, sizes, bits, keys``: the minimal perfect hash of each part of the distinct pairs."""
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())])

    def made(part: int, keys: list[int]) -> tuple:
        sizes, bits, own = perfect(np.array(keys, np.int64))
        return part, len(own), sizes, np.packbits(bits, bitorder="little").tobytes(), own.tobytes()

    part = F.floor(F.shiftright("pair", 32) / RANGE).alias("part")
    own = pairs.distinct().select(part, "pair").repartition(partitions(pairs.sparkSession), "part").sortWithinPartitions("part", "pair")
    return own.mapInArrow(lambda b: _by_part(b, made, schema), "part long, n long, sizes array<long>, bits binary, keys binary")


def _counted(tokens: DataFrame, index, a_file: str, b_file: str) -> DataFrame:  # noqa: ANN001
    """``part, task, counts``: of each task its vector, by parts, without those of zeros alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, a_table, b_table = _tools(a_file, b_file)
        own: Index = index.value
        counts = np.zeros(len(own.keys), np.uint32)
        for p in W.pieces(batches, 0, SLICE):
            for _, pair, _ in distinct_links(aligned(p.column(0), p.column(1), a_table, b_table)):
                np.add.at(counts, own.of(pair[own.mine(pair)]), 1)
        for k, part in enumerate(own.part.tolist()):
            some = counts[own.first[k] : own.first[k + 1]]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([some.astype("<i8").tobytes()], pa.binary())], ["part", "task", "counts"])

    return tokens.mapInArrow(run, "part long, task long, counts binary")


def tree_sum(vectors: DataFrame, tasks: int, fan: int = FAN) -> DataFrame:
    """``part, counts``: the sum of the vectors of each part, of ``fan`` tasks at a time."""
    schema = pa.schema([("part", pa.int64()), ("task", pa.int64()), ("counts", pa.binary())])

    def summed(part: int, task: int, vectors: list[bytes]) -> tuple:
        return part, task, sum(np.frombuffer(v, "<i8") for v in vectors).tobytes()

    for _ in range(max(1, math.ceil(math.log(max(tasks, 2), fan)))):
        met = vectors.select("part", F.floor(F.col("task") / fan).alias("task"), "counts").repartition(partitions(vectors.sparkSession), "part", "task")
        vectors = met.sortWithinPartitions("part", "task").mapInArrow(lambda b: _by_part(b, summed, schema, 2), "part long, task long, counts binary")
    return vectors.select("part", "counts")


def _decimals(a_table: Table, b_table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of A's and then of B's ids as rows of characters, which of these are shown, and how many."""
    width = max(a_table.digits.shape[1], b_table.digits.shape[1])
    digits = np.concatenate([np.pad(t.digits, ((0, 0), (width - t.digits.shape[1], 0))) for t in (a_table, b_table)])
    seen = np.concatenate([np.pad(t.shown, ((0, 0), (width - t.shown.shape[1], 0))) for t in (a_table, b_table)])
    return digits, seen, seen.sum(1)


def _described(x: Aligned, a_table: Table, b_table: Table, decimals: tuple) -> tuple[np.ndarray, list[str]]:
    """Groups of each document, and the hash of what they are."""
    digits, seen, length = decimals
    n_groups = np.diff(x.first_group)
    size_a, size_b = x.sizes
    begin_b, stop_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
    at_a, at_b = np.arange(len(x.a)) + begin_b[x.group_a], np.arange(len(x.b)) + stop_a[x.group_b]
    last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    ids = np.empty(len(x.a) + len(x.b), np.int64)  # of both in order, those of B behind all of A's
    ids[at_a], ids[at_b] = x.a, x.b + len(a_table.size)
    rows, shown = digits.take(ids, 0), seen.take(ids, 0)
    rows[at_a[last(x.group_a)], -1], rows[at_b[last(x.group_b)], -1] = ord("|"), ord(";")
    text = rows[shown].tobytes()
    edge = np.append(0, np.cumsum(length.take(ids)))[x.first_a + x.first_b].tolist()
    return n_groups, [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(edge, edge[1:], strict=False)]


def _looked_up(tokens: DataFrame, index, counts, best, a_file: str, b_file: str, out: T.StructType) -> DataFrame:  # noqa: ANN001
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, a_table, b_table = _tools(a_file, b_file)
        own, count, top = index.value, counts.value, best.value
        decimals = _decimals(a_table, b_table)
        for p in W.pieces(batches, 0, SLICE):
            x = aligned(p.column(0), p.column(1), a_table, b_table)
            n = p.num_rows
            n_links, n_best, total = (np.zeros(n, np.int64) for _ in range(3))
            for doc, pair, times in distinct_links(x):
                np.add.at(n_links, doc, times)
                mine = own.mine(pair)
                doc, times, at = doc[mine], times[mine], own.of(pair[mine])
                np.add.at(n_best, doc, times * top[at])
                np.add.at(total, doc, times * count[at])
            n_groups, sha = _described(x, a_table, b_table, decimals)
            made = [np.diff(x.first_a), np.diff(x.first_b), n_groups, n_links, n_best, total]
            yield pa.RecordBatch.from_arrays([*p.columns[2:], *(pa.array(c.astype(np.int64)) for c in made), pa.array(sha, pa.string())], schema=kind)

    return tokens.mapInArrow(run, out)


def with_alignment(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: list[str] | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``keep`` of ``docs`` (all if None) and of each row ``n_a, n_b, n_groups, n_links``, links whose pair has its A id's highest count ``n_best``, the
    counts over all links ``count_sum``, and ``groups_sha256`` of its groups as ``a1,a2|b1;a3|b2``."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    number, a_name, b_name = names = inner_names(docs, "number", "a", "b")
    tokens = written(tokenized(docs, a_file, b_file, text, keep, names), "tokens").select(a_name, b_name, number, *keep)
    ids = tokens.select(a_name, b_name)
    hashes = written(_hashes(_pairs(ids, a_file, b_file)), "hashes")

    rounds: list[list[int]] = [[]]
    held = 0
    for r in hashes.select("part", (F.length("bits") * 2 + F.col("n") * 17).alias("bytes")).orderBy("part").toLocalIterator():
        if rounds[-1] and held + r.bytes > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r.part)
        held += r.bytes
    found = None
    out = T.StructType([*tokens.schema[2:], *RESULT])
    for parts in rounds:
        mine = hashes.where(F.col("part").between(parts[0], parts[-1])) if parts else hashes
        index = Index([(r.part, list(r.sizes), bytes(r.bits), bytes(r.keys)) for r in mine.orderBy("part").collect()])
        shared = spark.sparkContext.broadcast(index)
        vectors = _counted(ids, shared, a_file, b_file)
        sums = written(tree_sum(vectors, ids.rdd.getNumPartitions()), "counts")
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(bytes(r.counts), "<i8") for r in sums.orderBy("part").collect())])
        highest = np.zeros(int(index.keys.max() >> 32) + 1 if len(index.keys) else 1, np.int64)
        np.maximum.at(highest, index.keys >> 32, counts)
        got = _looked_up(tokens, shared, spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(counts == highest[index.keys >> 32]), a_file, b_file, out)
        if len(rounds) > 1:
            got = written(got, "looked-up")
        found = got if found is None else found.unionByName(got)
    if len(rounds) > 1:
        first = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        one = found.groupBy(number).agg(*(F.first(c).alias(c) for c in (*keep, *first)), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = one
    return found.select(*keep, *RESULT.names)
