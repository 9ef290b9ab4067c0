"""Repair of conversations: the cheapest edits that give a conversation its form, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state), where the state tells what the roles so far allow next: nothing yet, after a system row, after a user
row, after an assistant row. Edges are edits: Keep, Rerole, Delete a row, Insert an empty one. Roles have to spell ``(s?(ua)+)?`` by their initials.
Two heaps search from the start and from the accepted ends. They stop once their least costs add up to more than the best crossing, so that all
crossings of that cost are known: edges from a node settled ahead to one settled from behind. Of the audits (prefix, edit, suffix) that cross at the
best cost the least string is taken. Of prefixes of equal cost to one node none is least whatever follows (``D`` + ``K`` comes after ``DI`` + ``K``),
but of those of one length the least is; so a node keeps one prefix, or suffix, for each length.

Conversations of any length: rows are parted by ranges of conversation and order, and what the lattice needs of a row is one letter. A run of
``SEGMENT`` rows is searched where it stands, from each state to each other; the results of a conversation's segments, whose audits are all that
is kept of them, are joined in order. The repaired rows are made by streaming over the rows behind their audit, so no task holds a
conversation's texts.

Defined cases: null roles and texts are one space, null turns come first, a null conversation is one of its own; rows of one turn go by hashes of
role and text; repeated rows are duplicates; a conversation without rows left has zeros and an empty audit; an empty table has no conversations;
texts of any length are read whole; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import partitions, written

#: Costs of the edits, and what an undeleted row without an end adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a conversation that are searched as one lattice.
SEGMENT = 256
#: States of the automaton by the initial read last, and where an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a reroled or inserted row is in each state: a user's but after a user's.
_FORCED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
_SPACES = " \t\n\x0b\x0c\r"

Label = tuple[int, dict[int, str]]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv_id, turn, role, text`` with faults by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its ends of sentences, 3
    repeats it, 4 makes it the user's. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn)).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("t", ".!?", "")).otherwise(F.col("t"))
    hurt = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain("role").alias("r"), plain("text").alias("t"), fault.alias("fault")).where("fault <> 0")
    hurt = hurt.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("r")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _order() -> list[Column]:
    """Two hashes of role and text, by which rows of one turn go."""
    return [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2")]


def diagnosed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, h1, h2, id, initial, fault`` of each row (``conv_id, turn, role, text``): its first fault of blank, duplicate and truncated."""
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    own = rows.select("conv_id", "turn", *_order(), F.substring("role", 1, 1).alias("initial"), last.alias("last"))
    own = written(own.withColumn("id", F.monotonically_increasing_id()), "marks")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "id")
    first = own.groupBy("conv_id", "h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.id").alias("first"))
    both = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("id") != F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return both.select("conv_id", "turn", "h1", "h2", "id", "initial", fault.alias("fault"))


def _letter() -> Column:
    """A row as the lattice sees it: x has to go; else the initial, o for others; a capital if it is truncated."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)


def _ahead(rows: str, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges out of a node: cost, edit, node."""
    yield INSERT, "I", i, _FORCED[q]
    if i < len(rows):
        c = rows[i]
        yield DELETE, "D", i + 1, q
        if c != "x":
            more = TRUNCATED * c.isupper()
            to = _NEXT.get(c.lower(), {}).get(q)
            if to is not None:
                yield more, "K", i + 1, to
            yield REROLE + more, "R", i + 1, _FORCED[q]


def _behind(rows: str, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges into a node: cost, edit, node."""
    for p in range(4):
        if _FORCED[p] == q:
            yield INSERT, "I", i, p
    if i:
        for p in range(4):
            for cost, edit, j, to in _ahead(rows, i - 1, p):
                if j == i and to == q:
                    yield cost, edit, i - 1, p


class _Side:
    """One of the two searches: a heap of costs, the settled nodes, and for each reached node its cost and an audit for each length."""

    def __init__(self, nodes: list[tuple[int, int]], way: int):
        self.way, self.reached, self.settled = way, {v: (0, {0: ""}) for v in nodes}, set()
        self.heap = [(0, way * i, q) for i, q in nodes]
        heapq.heapify(self.heap)

    def least(self) -> float:
        while self.heap and ((v := (self.way * self.heap[0][1], self.heap[0][2])) in self.settled or self.reached[v][0] < self.heap[0][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else math.inf

    def reach(self, v: tuple[int, int], cost: int, audits: dict[int, str]) -> None:
        old = self.reached.get(v)
        if old is None or cost < old[0]:
            self.reached[v] = (cost, dict(audits))
            heapq.heappush(self.heap, (cost, self.way * v[0], v[1]))
        elif cost == old[0]:
            for n, a in audits.items():
                if n not in old[1] or a < old[1][n]:
                    old[1][n] = a


def search(rows: str, start: int, ends: tuple[int, ...]) -> Label | None:
    """The least cost of editing ``rows`` from a state to one of ``ends``, and for each length of audit the least of that cost; None without a way."""
    ahead, behind = _Side([(0, start)], 1), _Side([(len(rows), q) for q in ends], -1)
    best, crossings = (0, [({0: ""}, "", {0: ""})]) if not rows and start in ends else (math.inf, [])
    while (f := ahead.least()) + (b := behind.least()) <= best and f + b < math.inf:
        # a node's audits are complete when it is settled: an edge of no cost leads to another row, and rows come off a heap in order
        side, other, edges = (ahead, behind, _ahead) if f <= b else (behind, ahead, _behind)
        cost, i, q = heapq.heappop(side.heap)
        i *= side.way
        side.settled.add((i, q))
        audits = side.reached[i, q][1]
        for more, edit, j, to in edges(rows, i, q):
            side.reach((j, to), cost + more, {n + 1: a + edit if side is ahead else edit + a for n, a in audits.items()})
            if (j, to) in other.settled:
                rest, across = other.reached[j, to]
                if cost + more + rest < best:
                    best, crossings = cost + more + rest, []
                if cost + more + rest == best:
                    crossings.append((audits, edit, across) if side is ahead else (across, edit, audits))
    if best == math.inf:
        return None
    found: dict[int, str] = {}
    for head, edit, tail in crossings:
        for n, a in head.items():
            for m, z in tail.items():
                whole, k = a + edit + z, n + m + len(edit)
                if k not in found or whole < found[k]:
                    found[k] = whole
    return int(best), found


def passages(rows: str) -> dict[tuple[int, int], Label]:
    """The searches from each state to each other."""
    found = {(p, q): search(rows, p, (q,)) for p in range(4) for q in range(4) if q >= min(p, USER)}
    return {k: v for k, v in found.items() if v}


def joined(labels: dict[int, Label], step: dict[tuple[int, int], Label]) -> dict[int, Label]:
    """The labels of the states behind one more segment."""
    out: dict[int, Label] = {}
    for (p, q), (cost, audits) in step.items():
        if p in labels:
            so_far, heads = labels[p]
            old = out.get(q)
            if old is None or so_far + cost <= old[0]:
                mine = dict(old[1]) if old and old[0] == so_far + cost else {}
                for n, a in heads.items():
                    for m, z in audits.items():
                        if n + m not in mine or a + z < mine[n + m]:
                            mine[n + m] = a + z
                out[q] = (so_far + cost, mine)
    return out


_STEP = "array<struct<p: int, q: int, cost: bigint, audits: array<string>>>"


def _runs(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order as runs of at most ``SEGMENT`` letters; a full run with its passages, as its conversation likely goes on."""
    out: list[tuple] = []
    now: tuple | None = None
    first, letters, count = None, [], 0

    def ended() -> None:
        nonlocal letters, count
        if letters:
            rows = "".join(x for x, _ in letters)
            marks = [m for _, m in letters]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
            step = [{"p": p, "q": q, "cost": c, "audits": list(a.values())} for (p, q), (c, a) in passages(rows).items()] if len(letters) == SEGMENT else None
            out.append((now[0], *first, rows, step, bad, marks[0], marks[-1], count))
            letters, count = [], count + 1

    for b in batches:
        for conv, turn, h1, h2, at, letter, initial in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (conv,) or len(letters) == SEGMENT:
                ended()
                now, first = (conv,), (turn, h1, h2, at)
            letters.append((letter, initial))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)
            out = []
    ended()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)


def _audited(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Runs in order to a row for each conversation."""
    out: list[tuple] = []
    now, single, labels, bad, last, before = None, None, {}, 0, None, {}

    def ended() -> None:
        if now is not None:
            ways = [search(single, START, ACCEPTED)] if single is not None else [labels[q] for q in ACCEPTED if q in labels]
            least = min(cost for cost, _ in ways)
            out.append((now[0], bad, least, min(a for cost, found in ways if cost == least for a in found.values())))

    for b in batches:
        for conv, rows, step, own_bad, one, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (conv,):
                ended()
                now, single, bad = (conv,), rows, own_bad
                labels = {}
            else:
                if single is not None:
                    labels, single = joined({START: (0, {0: ""})}, before or passages(single)), None
                labels = joined(labels, _read(step) or passages(rows))
                bad += own_bad + (last + one not in ("su", "ua", "au"))
            before, last = _read(step), end
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)
            out = []
    ended()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)


def _read(step: list[dict] | None) -> dict[tuple[int, int], Label]:
    return {(s["p"], s["q"]): (s["cost"], {len(a): a for a in s["audits"]}) for s in step or []}


def _in_order(by: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in by]


def audits(marks: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation of diagnosed rows."""
    spark, conv = marks.sparkSession, marks.schema["conv_id"]
    by = ["conv_id", "turn", "h1", "h2", "id"]
    lined = marks.select(*by, _letter().alias("letter"), "initial").repartitionByRange(partitions(spark), *_in_order(by)).sortWithinPartitions(*_in_order(by))
    ddl = f"h1 long, h2 long, id long, letters string, step {_STEP}, illegal long, one string, last string, run long"
    run = T.StructType([conv, marks.schema["turn"], *T.StructType.fromDDL(ddl)])
    kind = to_arrow_schema(run)
    runs = lined.mapInArrow(lambda b: _runs(b, kind), run)
    met = runs.repartition(partitions(spark), "conv_id").sortWithinPartitions(*_in_order(by)).select("conv_id", "letters", "step", "illegal", "one", "last")
    done = T.StructType([conv, *T.StructType.fromDDL("illegal long, cost long, audit string")])
    as_rows = to_arrow_schema(done)
    return met.mapInArrow(lambda b: _audited(b, as_rows), done)


def _mended(batches: Iterator[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each conversation's rows behind its audit, edited by it."""
    out: list[tuple] = []
    now, audit, k, q, place, held = None, "", 0, START, 0, 0

    def put(role: str, text: str, edit: str) -> None:
        nonlocal place, held
        out.append((now, place, edit, role, text))
        place, held = place + 1, held + len(text)

    def inserted() -> None:
        nonlocal k, q
        while audit[k : k + 1] == "I":
            k, q = k + 1, _FORCED[q]
            put(_NAMES[q], "", "I")

    def full() -> pa.RecordBatch:
        nonlocal held
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
        out.clear()
        held = 0
        return made

    for b in W.pieces(batches, "text"):
        for conv, known, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if known is not None:
                inserted()
                now, audit, k, q, place = conv, known, 0, START, 0
                continue
            inserted()
            edit, k = audit[k], k + 1
            if edit == "K":
                q = _NEXT[role[0]][q]
                put(role, text, edit)
            elif edit == "R":
                q = _FORCED[q]
                put(_NAMES[q], text, edit)
            if len(out) >= 2000 or held > 2_000_000:
                yield full()
        if out:
            yield full()
    inserted()
    if out:
        yield full()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows that the audits ``found`` leave, change and add. Those of a conversation stand in one partition, in
    order."""
    spark, conv = rows.sparkSession, rows.schema["conv_id"]
    null = lambda kind: F.lit(None).cast(kind)
    names = ["conv_id", "turn", "h1", "h2", "audit", "role", "text"]
    own = rows.select("conv_id", "turn", *_order(), null("string").alias("audit"), "role", "text", F.lit(1).alias("kind"))
    head = found.select("conv_id", null(rows.schema["turn"].dataType).alias("turn"), null("long").alias("h1"), null("long").alias("h2"), "audit", null("string").alias("role"), null("string").alias("text"), F.lit(0).alias("kind"))
    lined = own.unionByName(head).repartition(partitions(spark), "conv_id").sortWithinPartitions(*_in_order(["conv_id", "kind", "turn", "h1", "h2"])).select(*names)
    out = T.StructType([conv, *T.StructType.fromDDL("place long, edit string, role string, text string")])
    kind = to_arrow_schema(out)
    return lined.mapInArrow(lambda b: _mended(b, kind), out)


def digests(mended: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows as they stand: SHA-256 of the lines ``role:text``."""
    out = T.StructType([mended.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    kind = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, done = None, None, []
        for b in batches:
            for conv, place, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not place:
                    if hashed:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = conv, hashlib.sha256()
                hashed.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
                done = []
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind[0].type), pa.array([hashed.hexdigest()])], schema=kind)

    return mended.select("conv_id", "place", "role", "text").mapInArrow(run, out)


def report(rows: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each conversation of ``every`` (``conv_id``) its gaps, faults, cost and audit; and the repaired rows."""
    marks = written(diagnosed(rows), "diagnosed")
    found = written(audits(marks), "audits")
    counts = marks.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == n).alias(n) for n in ("blank", "duplicate", "truncated")))
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = every.select("conv_id").distinct()
    for part in (gaps, counts, found):
        out = beside(out, part)
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero), F.coalesce("audit", F.lit("")).alias("audit")), repaired(rows, found)


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join by conversation, where a null one is one, too."""
    named = right.withColumnRenamed("conv_id", "__conv")
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
