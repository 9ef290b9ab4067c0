"""Packing documents into training sequences by order-preserving dynamic programming.

Documents are tokenised in place and laid end to end in the order of the scan, each ended by one token. A sequence is a run of at most ``SIZE``
tokens of that line. Cuts may stand after a document or a sentence; where a sentence is longer than a sequence, also at every ``SIZE`` tokens in it.
With ``p[j]`` the place of cut j, the least cost up to it is

    best[j] = min over i with p[j] - p[i] <= SIZE of best[i] + SIZE - (p[j] - p[i]) + penalty[j]

(padding plus a penalty for a document that is cut short), so the best i is the least of ``best[i] + p[i]`` in a moving window: a monotone queue
gives it in constant time. Runs whose length is a power of two need no padding and are tried besides. The queue goes on over a whole partition's
line. Every place that a later cut can still follow is less than ``SIZE`` tokens from the end; as soon as the best ways to all of these go through
one common cut, the cuts up to it are settled, and their sequences are given out. Should they not meet within ``HORIZON`` places, which bounds a
worker's memory, the way to the last place is taken. The end of a partition is split into powers of two.

Sequences follow the scan's partitions, so nothing is shuffled: the id of a sequence is its partition and its number there.

Defined cases: a null text is an empty one, that is its end token alone; repeated rows are packed each, as rows; ties between cuts go to the earlier
one; very long texts are cut into pieces; an empty table has no pieces; a column with the name of a piece's column is replaced by it.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
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

SIZE = 1024
#: Cost of cutting a document at the end of a sentence, of cutting a sentence, and of one more sequence, in tokens of padding.
CUT_DOCUMENT, CUT_SENTENCE, SEQUENCE = 4, 64, 8
#: Places whose cuts may stay unsettled.
HORIZON = 2_000_000
#: Bytes of text that are tokenised at once.
SLICE = 2_000_000
#: Pieces of text that a worker remembers the tokens of, in either of two generations, and the longest of them.
MEMORY, LONGEST = 150_000, 100

PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

_SPACE = W.lookup((0x09, 0x0D), (0x1C, 0x20))
_LETTER = W.lookup((0x41, 0x5A), (0x61, 0x7A))
_MARK = W.lookup((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: First bytes of characters beyond ASCII that may be white space, and what stands before the last byte of such a one.
_WIDE_FIRST, _WIDE_LAST = W.lookup((0xC2, 0xC2), (0xE1, 0xE3)), W.lookup((0x80, 0x81), (0x9A, 0x9A), (0xA0, 0xA0), (0xC2, 0xC2))


def _edges(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the splitting pattern of the tokenizer surely parts the texts ``data[first[k]:first[k + 1]]``, whatever stands around.

    That is before a space that follows no white space, or that something else than white space follows; between an ASCII letter and another ASCII
    character; between a mark and a line's end; and between a single line's end and a letter.
    """
    n = len(data)
    pad = np.concatenate((data, np.zeros(1, np.uint8)))
    prev, before, after = np.roll(pad, 1)[:n], np.roll(pad, 2)[:n], pad[1:]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    inner = ~begins[:n]
    sure_prev = np.where(prev < 128, ~_SPACE[prev], ~_WIDE_LAST[before])
    sure_after = ~(_SPACE[after] | _WIDE_FIRST[after] | begins[1:])
    line = data == 10
    cut = (data == 32) & (sure_prev | sure_after)
    cut |= _LETTER[prev] & (_MARK[data] | line | (data == 39))
    cut |= _MARK[prev] & line
    cut |= (prev == 10) & _LETTER[data] & (before < 128) & ~_SPACE[before] & np.roll(inner, 1)
    return np.flatnonzero(begins[:n] | cut & inner)


class Tokens:
    """Token ids by a public byte-level BPE file, each distinct piece of text being tokenized once and then remembered.

    Pieces are parted where the file's own splitting pattern does, which has to be the usual one of byte-level files, without a normalizer; texts are
    given whole to the tokenizer of another file. So is a text that holds a special token, unless ``plain``: then its string is ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = plain
        own = json.loads(self.tool.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.usual = own["normalizer"] is None and {k: v for k, v in (own["pre_tokenizer"] or {}).items() if k in usual} == usual and own["model"].get("dropout") is None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.special = [] if plain else [t.content for t in self.tool.get_added_tokens_decoder().values()]
        vocabulary = self.tool.get_vocab(with_added_tokens=True)
        self.ends, self.begins = np.zeros((2, max(vocabulary.values()) + 1), bool)
        for token, k in vocabulary.items():
            self.begins[k] = token.startswith("Ġ")
            self.ends[k] = token.endswith((".", "!", "?", "Ċ"))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many are each one's; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        at = self._parts(data, offsets)
        for token in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(False)):
                at = at[(at <= offsets[k]) | (at >= offsets[k + 1])]
        ends = np.append(at, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        which, found = pieces.indices.to_numpy(), self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        store, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[which]
        stop = np.cumsum(n)
        ids = store[np.arange(stop[-1]) + np.repeat(begin[which] - stop + n, n)]
        upto = np.append(0, stop)[np.searchsorted(at, offsets)]
        return ids, np.diff(upto)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _edges(data, offsets) if self.usual else np.unique(offsets[offsets < len(data)])

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY:
            self.known, self.before = {}, self.known
        out = list(map(self.known.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        fresh = self._fresh([pieces[k] for k in missing if pieces[k] not in self.before])
        for k in missing:
            p = pieces[k]
            out[k] = ids = fresh[p] if p in fresh else self.before[p]
            if len(p) <= LONGEST:
                self.known[p] = ids
        return out

    def _fresh(self, new: list[str]) -> dict[str, bytes]:
        """ASCII letters need no splitting. Pieces of a space and what follows it go in long runs, parted again where a token begins with a space."""
        out: dict[str, bytes] = {}
        joined, single, model = [], [], self.tool.model
        if not self.usual:
            new, single = [], new
        for p in new:
            word = p[1:] if p[:1] == " " else p
            if word is p and p.isascii() and p.isalpha():
                out[p] = array("I", [t.id for t in model.tokenize(p)]).tobytes()
            elif word is not p and word and " " not in word and not word[0].isspace() and len(p) <= LONGEST:
                joined.append(p)
            else:
                single.append(p)
        runs = [joined[k : k + 500] for k in range(0, len(joined), 500)]
        for run, e in zip(runs, self.tool.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
            if len(at) == len(run) + 1:
                raw, at = ids.tobytes(), at.tolist()
                out.update(zip(run, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                single += run
        for p, e in zip(single, self.tool.encode_batch_fast(single, add_special_tokens=False), strict=True):
            out[p] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(2)
def _tokens(path: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(path)


class Cuts:
    """The best cuts of a line whose places come bit by bit, ascending, with no gap over ``size``."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
        #: Of the places from the last settled cut on: where, the least cost up to there, the cut before; and the queue of places, cheapest first.
        self.place, self.best, self.back = [0], [0], [0]
        self.queue = deque([0])

    def add(self, places: np.ndarray, penalty: np.ndarray) -> None:
        old, size = len(self.place), self.size
        p, best, back, queue = self.place, self.best, self.back, self.queue
        low = p[-1] - size
        near = np.array(p[self._live() :])
        index = np.full(int(places[-1]) - low + 1, -1)
        index[near - low] = np.arange(old - len(near), old)
        index[places - low] = np.arange(old, old + len(places))
        hits = []
        for w in self.powers:
            k = index[np.maximum(places - w - low, 0)]
            some = np.flatnonzero((k >= 0) & (places - w >= low))
            hits.append(np.stack((some, k[some])))
        even = np.concatenate(hits, 1)
        even = even[:, np.argsort(even[0], kind="stable")]
        until = np.searchsorted(even[0], np.arange(1, len(places) + 1)).tolist()
        other = even[1].tolist()
        price = [b + a for a, b in zip(p, best, strict=True)]
        at = 0
        for j, (pj, cost, end) in enumerate(zip(places.tolist(), penalty.tolist(), until, strict=True), old):
            far = pj - size
            while p[queue[0]] < far:
                queue.popleft()
            i = queue[0]
            least = price[i] - far
            while at < end:
                k = other[at]
                if best[k] < least:
                    least, i = best[k], k
                at += 1
            least += cost + SEQUENCE
            k = least + pj
            p.append(pj)
            best.append(least)
            back.append(i)
            price.append(k)
            while queue and price[queue[-1]] >= k:
                queue.pop()
            queue.append(j)

    def _live(self) -> int:
        """The first place that a later cut can follow."""
        p, low = self.place, len(self.place) - 1
        while low and p[low - 1] + self.size > p[-1]:
            low -= 1
        return low

    def settled(self, last: bool = False) -> np.ndarray:
        """The cuts that nothing to come can change, from the one settled before to the newest; ``last``: all that remain."""
        back, live = self.back, self._live()
        top = len(back) - 1
        if not last and top < HORIZON:
            ways = set(range(live, top + 1))
            while len(ways) > 1:  # the way from the latest of them goes through its cut before
                ways.add(back[top])
                ways.discard(top)
                top -= 1
                while top not in ways:
                    top -= 1
        way = [top]
        while way[-1]:
            way.append(back[way[-1]])
        out = np.array([self.place[k] for k in reversed(way)])
        if top:
            self.place, self.best = self.place[top:], [b - self.best[top] for b in self.best[top:]]
            self.back = [max(0, k - top) for k in back[top:]]
            self.queue = deque(k - top for k in self.queue if k >= top)
        return out


class Line:
    """Documents laid end to end, packed as far as cuts are settled."""

    def __init__(self, ends: np.ndarray, prefix: int, schema: pa.Schema):
        self.ends, self.sequence, self.schema = ends, prefix, schema
        self.cuts = Cuts()
        #: What is still to be packed: rows of documents, where each begins and has its end, and the tokens from ``done`` on.
        self.rows: list[pa.RecordBatch] = []
        self.first, self.stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.done = np.zeros(0, np.uint32), 0

    def _places(self, ids: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents that end at ``stop`` may be cut, and what each cut costs."""
        inner = np.flatnonzero(self.ends[ids]) + 1
        inner = inner[~np.isin(inner, stop, assume_unique=True)]
        edges = np.sort(np.concatenate((inner, stop)))
        left = np.append(0, edges[:-1])
        long = edges - left > SIZE
        forced = [np.arange(a + SIZE, b, SIZE) for a, b in zip(left[long], edges[long], strict=True)]
        places = np.concatenate((stop, inner, *forced))
        costs = np.zeros(len(places), np.int64)
        costs[len(stop) :] = CUT_DOCUMENT
        costs[len(stop) + len(inner) :] = CUT_SENTENCE
        order = np.argsort(places)
        return places[order], costs[order]

    def add(self, rows: pa.RecordBatch, ids: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        """Documents whose ids end at ``stop``; the pieces that are settled by them. The last column of ``rows`` goes."""
        end = self.done + len(self.ids)
        places, costs = self._places(ids, stop)
        self.cuts.add(places + end, costs)
        self.rows.append(rows)
        self.first, self.stop = np.concatenate((self.first, np.append(0, stop[:-1]) + end)), np.concatenate((self.stop, stop + end))
        self.ids = np.concatenate((self.ids, ids))
        return self._pieces(self.cuts.settled())

    def finish(self) -> pa.RecordBatch:
        cuts = self.cuts.settled(True)
        if len(cuts) > 1:  # an end that would be padded is split into powers of two
            rest = int(cuts[-1] - cuts[-2])
            cuts = np.concatenate((cuts[:-1], cuts[-2] + np.cumsum([1 << k for k in range(SIZE.bit_length() - 1, -1, -1) if rest >> k & 1])))
        return self._pieces(cuts)

    def _pieces(self, cuts: np.ndarray) -> pa.RecordBatch:
        if len(cuts) < 2:
            return pa.RecordBatch.from_pylist([], self.schema)
        begun = self.first[(self.first >= cuts[0]) & (self.first < cuts[-1])]
        edge = np.union1d(cuts, begun)
        start, length = edge[:-1], np.diff(edge)
        doc = np.searchsorted(self.first, start, "right") - 1
        seq = np.searchsorted(cuts, start, "right") - 1
        raw, at = memoryview(self.ids.tobytes()), ((edge - self.done) * 4).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
        made = [start - self.first[doc], length, crc, (self.stop - self.first)[doc], self.sequence + seq, start - cuts[seq]]
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        own = rows.take(pa.array(doc)).columns[:-1]
        self.sequence += len(cuts) - 1
        left = int(np.searchsorted(self.stop, cuts[-1], "right"))
        self.rows = rows.slice(left).to_batches()
        self.first, self.stop = self.first[left:], self.stop[left:]
        self.ids, self.done = self.ids[int(cuts[-1]) - self.done :], int(cuts[-1])
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in own), *(pa.array(c, pa.int64()) for c in made)], schema=self.schema)


def packed(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece: ``keep`` of the document (all its columns but the text if None) and the columns of ``PIECE``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {text, *PIECE.names}]
    schema = T.StructType([*(docs.schema[c] for c in keep), *PIECE])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens(tokenizer)
        line = Line(tokens.ends, TaskContext.get().partitionId() << 33, made)
        for b in W.pieces(batches, 0, SLICE):
            own, n = tokens.of(b.column(0))
            stop = np.cumsum(n + 1)
            ids = np.full(len(own) + len(n), end_id, np.uint32)
            ids[np.arange(len(own)) + np.repeat(np.arange(len(n)), n)] = own
            yield line.add(b.remove_column(0), ids, stop)
        yield line.finish()

    return docs.select(F.col(text).cast("string").alias("__text"), *keep, F.lit(0).alias("__line")).mapInArrow(run, schema)
