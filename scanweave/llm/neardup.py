"""Near-duplicate classes by ProbMinHash, banding and verification.

Signatures. A text's shingles are five words each, a shingle of ``n`` places in it weighs 1 + ln(n). Each shingle sends arrivals of a Poisson process
of that rate, drawn from its hash alone, to random registers; a register keeps the shingle that came first. Arrivals of a shingle end as soon as they
come later than the text's latest register (early termination), so work is about the number of shingles plus that of registers times its logarithm.
Two registers agree with the texts' probability Jaccard similarity, the sum over common shingles i of 1 / sum over all j of max(x[j] / x[i], y[j] / y[i]).
It does not change if all weights of a text are scaled, and it is the plain similarity of sets where all weights are equal, as with ``weighted=False``.

Classes. The members are the distinct texts, whatever the ids of their rows, and a member's number means nothing else. Members that agree in all
``ROWS`` registers of one of ``BANDS`` bands share a bucket (0.05 % of pairs at exactly 0.8 never do). Then pairs are verified: the exact similarity,
by the same weights as the signatures', is at least ``SIMILARITY``.

1. All members of a bucket against its hub, the member that shares most buckets with others, by their members: in a class of copies of one text that is
   the text itself, if it is there.
2. Buckets that then still hold several components: each pair of different components whose first common band this is, and whose registers let
   ``SIMILARITY`` seem possible (within seven deviations), in blocks of bounded members and bytes; a pair that a component already joins needs no check.

So no link found by banding is lost, and no bucket is expanded into pairs of rows.

Defined cases: a null text is an empty one; a text of fewer than five words, but not none, is one shingle; texts without words are alike only if they
are equal; an id only labels a class, so rows that share an id, or have none, are of one class only if their texts are; null ids come after any other;
ties between texts with equal ids go by hashes of the texts; repeated rows are of one class; an empty table has no classes; a column named like a
result is replaced, and other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NULL_ID, components, inner_names, maybe_in, partitions, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
#: Members, and bytes of their shingles, of a block, two of which are compared in one task.
BLOCK, BLOCK_BYTES = 512, 2_000_000
#: The share of agreeing registers below which ``SIMILARITY`` is out of reach.
LIKELY = SIMILARITY - 7 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5


def shingles(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, by text and hash."""
    n = np.diff(w.first)
    start = W.window_starts(w, SHINGLE)
    short = w.first[:-1][(n > 0) & (n < SHINGLE)]
    end = np.concatenate((start + SHINGLE, w.first[1:][(n > 0) & (n < SHINGLE)]))
    start = np.concatenate((start, short))
    h = W.range_hash(w.hashes(), start, end, 1)
    doc = np.searchsorted(w.first, start, "right") - 1
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """Registers of each text, 16 bits of the shingle in each; a text without shingles has zeros."""
    best = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, np.uint16)
    weight = 1 + np.log(count)
    time = np.zeros(len(h))
    rounds = 0
    while len(h):
        rounds += 1
        draw = W.mix(h + np.uint64((rounds * 0x9E3779B97F4A7C15) % 2**64))
        time = time - np.log((((draw >> np.uint64(12)) | np.uint64(1)).astype(np.float64)) * 2.0**-52) / weight
        register = doc * m + ((W.mix(draw) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, register, time)
        won = best[register] == time
        kept[register[won]] = (W.mix(h[won] ^ np.uint64(0x5BD1E995)) >> np.uint64(48)).astype(np.uint16)
        latest = best.reshape(n_docs, m).max(1)
        more = time < latest[doc]
        doc, h, weight, time = doc[more], h[more], weight[more], time[more]
    return kept.reshape(n_docs, m)


def _band_codes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit code of each band of each signature; it tells the band, too."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    code = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.ones((len(sig), 1), np.uint64)
    for k in range(ROWS):
        code = W.mix(code * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return code


def _counted(column: pa.Array, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, h, count = shingles(W.words(column))
    return doc, h, count if weighted else np.ones(len(h), int)


def _signed(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    for b in W.pieces(batches):
        doc, h, count = _counted(b.column(0), weighted)
        sig = signatures(doc, h, count, b.num_rows)
        n = np.bincount(doc, minlength=b.num_rows)
        raw = [s.tobytes() if k else b"" for s, k in zip(sig, n, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("t1"), b.column("t2"), pa.array(raw, pa.binary())], ["doc", "t1", "t2", "sig"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            c = b.slice(at, 2000)
            sig = np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            node = np.repeat(c.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(_band_codes(sig).ravel().view(np.int64)), pa.array(node)], ["key", "node"])


def _sets(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
    """The sorted hashes of each text's shingles, and how often each occurs; nothing where all occur once."""
    for b in W.pieces(batches):
        doc, h, count = _counted(b.column(0), weighted)
        edge = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist()
        spans = list(zip(edge, edge[1:], strict=False))
        sets = [h[i:j].tobytes() for i, j in spans]
        counts = [count[i:j].astype(np.uint32).tobytes() if (count[i:j] > 1).any() else b"" for i, j in spans]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["node", "shingles", "counts"])


def _read(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes and weights; no weights where all are 1."""
    return np.frombuffer(shingles, np.uint64), 1 + np.log(np.frombuffer(counts, np.uint32)) if counts else None


def similarity(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None]) -> float:
    """The exact probability Jaccard similarity of two texts, each sorted hashes and their weights."""
    (a, u), (b, v) = x, y
    if not len(a) or not len(b) or u is None and v is None and min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    k = np.searchsorted(b, a)
    k[k == len(b)] = 0
    both = b[k] == a
    n = int(both.sum())
    if u is None and v is None:
        return n / (len(a) + len(b) - n)
    u, v = (np.ones(len(h)) if w is None else w for h, w in ((a, u), (b, v)))
    common = u[both], v[k[both]]
    ratio = common[1] / common[0]
    order = np.argsort(ratio)
    # for i: its x over the x of shingles whose ratio y / x is at most i's, plus the y of the others over i's ratio
    same = np.searchsorted(ratio[order], ratio, "right")
    low, high = (np.append(0, np.cumsum(c[order])) for c in common)
    return float((common[0] / (u.sum() - low[-1] + low[same] + (v.sum() - high[same]) / ratio)).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (some for whole in batches for part in W.pieces(iter([whole]), "sa", BLOCK_BYTES) for some in W.pieces(iter([part]), "sb", BLOCK_BYTES)):
        rows = zip(*(b.column(c).to_pylist() for c in ("sa", "ca", "sb", "cb")), strict=True)
        ok = pa.array([similarity(_read(sa, ca), _read(sb, cb)) >= SIMILARITY for sa, ca, sb, cb in rows], pa.bool_())
        yield b.select(["a", "b"]).filter(ok)
    W.give_back()


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[dict]]:
    """Rows that stand together and agree in ``columns``."""
    rows: list[dict] = []
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for r in b.slice(at, 256).to_pylist():
                if rows and any(rows[0][c] != r[c] for c in columns):
                    yield rows
                    rows = []
                rows.append(r)
    if rows:
        yield rows


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of a bucket, or of two blocks of a large one: a pair only if it joins what is not joined yet."""
    for rows in _groups(batches, ["key", "i", "j"]):
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, REGISTERS)
        codes = _band_codes(sig).view(np.int64)
        band = int(np.flatnonzero(codes[0] == rows[0]["key"])[0])
        names = {x: k for k, x in enumerate(sorted({r["label"] for r in rows}))}
        label = np.array([names[r["label"]] for r in rows])
        block = np.array([r["g"] for r in rows])
        sets = [_read(r["shingles"], r["counts"]) for r in rows]
        a, b = [], []
        cross = rows[0]["i"] != rows[0]["j"]
        for x in range(len(rows)):
            other = np.flatnonzero(label[x + 1 :] != label[x]) + x + 1
            if cross:
                other = other[block[other] != block[x]]
            if len(other) and band:
                other = other[~(codes[other, :band] == codes[x, :band]).any(1)]
            if len(other):
                alike = (sig[other] == sig[x]).mean(1)
                order = np.argsort(-alike)
                for y in other[order][alike[order] >= LIKELY].tolist():
                    if label[y] != label[x] and similarity(sets[x], sets[y]) >= SIMILARITY:
                        a.append(rows[x]["node"])
                        b.append(rows[y]["node"])
                        label[label == label[y]] = label[x]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    W.give_back()


def _marks(text: str) -> list[Column]:
    """Two hashes that stand for a text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """A row for each distinct text, by its hashes ``t1, t2``: ``class_id``, the least id of its class, and ``l1, l2``, the text of the least (id, text) there."""
    spark = docs.sparkSession
    t1, t2 = _marks(text)
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("doc"), t1.alias("t1"), t2.alias("t2"))
    signed = own.mapInArrow(lambda rows: _signed(rows, weighted), "doc long, t1 long, t2 long, sig binary")
    member = signed.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.max("sig").alias("sig"))
    member = written(member.withColumn("node", F.monotonically_increasing_id()), "signatures")

    rows = member.where(F.length("sig") > 0).select("node", "sig").mapInArrow(_banded, "key long, node long")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("l"), F.max("node").alias("m")).where("l < m").select("key", "n")
    bucket = written(rows.join(shared, "key").distinct(), "buckets")
    degree = bucket.groupBy("node").agg(F.sum("n").alias("degree"))
    hub = bucket.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub")).select("key", F.col("hub.node").alias("a"))

    # of the rows of a text only those with its least id, and of these one
    key = F.xxhash64("doc", "t1", "t2").alias("key")
    needed = bucket.select("node").distinct().join(member.select("node", "doc", "t1", "t2"), "node")
    needed = written(needed.select("node", F.coalesce("doc", F.lit(NULL_ID)).alias("doc"), "t1", "t2"), "needed")
    each = own.withColumn("doc", F.coalesce("doc", F.lit(NULL_ID)))
    likely = maybe_in(each.select("t", "doc", "t1", "t2", key), "key", needed.select(key)).where("maybe").select("t", "doc", "t1", "t2")
    text_of = likely.join(needed, ["doc", "t1", "t2"]).dropDuplicates(["doc", "t1", "t2"]).select("t", "node")
    sets = written(text_of.mapInArrow(lambda rows: _sets(rows, weighted), "node long, shingles binary, counts binary").where(F.length("shingles") > 0), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))
        return written(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_verified, "a long, b long"), "links")

    links = verified(bucket.select("key", F.col("node").alias("b")).join(hub, "key").where("a <> b").select("a", "b").distinct())
    now = bucket.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    now = written(now, "labelled")

    part = now.join(sets.select("node", (F.length("shingles") + F.length("counts")).alias("bytes")), "node")
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    size = [F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")]
    open_ = part.groupBy("key").agg(*size).where("l0 < l1").select("key", count.alias("n"))
    blocks = now.join(open_, "key").withColumn("g", F.pmod(F.xxhash64("node", "key"), "n").cast("int"))
    blocks = blocks.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    blocks = blocks.select("key", "node", "label", "g", F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"))
    full = blocks.join(sets, "node").join(member.select("node", "sig").where(F.length("sig") > 0), "node")
    full = full.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    more = full.select("key", "i", "j", "g", "node", "label", "sig", "shingles", "counts").mapInArrow(_compared, "a long, b long")

    found = components(links.union(more))
    chain = found.join(member.select("node", "doc", "t1", "t2"), "node")
    chain = chain.select("label", "t1", "t2", F.struct(F.col("doc").isNull().alias("none"), "doc", "t1", "t2").alias("one"))
    lead = chain.groupBy("label").agg(F.min("one").alias("lead"))
    linked = written(chain.join(lead, "label").select("t1", "t2", "lead.doc", F.col("lead.t1").alias("l1"), F.col("lead.t2").alias("l2")), "linked")
    both = member.select("t1", "t2", F.col("doc").alias("own")).join(linked, ["t1", "t2"], "left")
    return both.select("t1", "t2", F.when(F.col("l1").isNull(), F.col("own")).otherwise(F.col("doc")).alias("class_id"), F.coalesce("l1", "t1").alias("l1"), F.coalesce("l2", "t2").alias("l2"))


def with_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, weighted: bool = True) -> DataFrame:
    """``keep`` of ``docs`` (all if None) and ``class_id``, null for a class that only null ids have."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "class_id"]
    (t1, t2), (own1, own2) = _marks(text), inner_names(docs, "t1", "t2")
    found = classes(docs, id_col, text, weighted).select(F.col("t1").alias(own1), F.col("t2").alias(own2), "class_id")
    return docs.select(*keep, t1.alias(own1), t2.alias(own2)).join(found, [own1, own2]).select(*keep, "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", weighted: bool = True) -> DataFrame:
    """The row of each class with the least id, and of texts that share it the least hashes, with the columns of ``docs``; of rows that repeat both, one.

    Rows that neither go nor repeat an id and text, which are most, are passed on in place.
    """
    t1, t2 = _marks(text)
    doc, own1, own2, key, maybe, stays = inner_names(docs, "doc", "t1", "t2", "key", "maybe", "stays")
    row = [doc, own1, own2]
    own = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), own1: t1, own2: t2})
    found = classes(docs, id_col, text, weighted).select(F.col("t1").alias(own1), F.col("t2").alias(own2), F.coalesce("class_id", F.lit(NULL_ID)).alias("lead"), "l1", "l2")
    each = own.groupBy(*row).agg(F.count("*").alias("n")).join(found, [own1, own2])
    each = each.withColumn(stays, (F.col(doc) == F.col("lead")) & (F.col(own1) == F.col("l1")) & (F.col(own2) == F.col("l2")))
    special = written(each.where(f"n > 1 or not {stays}").select(*row, stays), "special")
    own = maybe_in(own.withColumn(key, F.xxhash64(*row)), key, special.select(F.xxhash64(*row).alias("key")), maybe)
    judged = own.where(maybe).join(special, row, "left").where(f"coalesce({stays}, true)")
    one = judged.where(f"{stays} is not null").dropDuplicates(row).unionByName(judged.where(f"{stays} is null"))
    return own.where(f"not {maybe}").select(*docs.columns).unionByName(one.select(*docs.columns))
