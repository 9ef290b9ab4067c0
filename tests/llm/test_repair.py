"""Repair of conversations against brute force: a recursion over suffixes, whose least is known at once."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from scanweave.llm import common, queries, repair
from tests.conftest import canonical

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows, start=0, ends=(0, 3), most=None):
    """The least (cost, audit) by plain recursion: rows as (initial, must go, truncated)."""
    most = len(rows) * 3 + 8 if most is None else most

    @cache
    def best(i, q, inserts):
        ways = [(0, "")] if i == len(rows) and q in ends else []
        if inserts:
            for r, to in NEXT[q].items():
                if r != "s":
                    cost, audit = best(i, to, inserts - 1)
                    ways.append((cost + 2, "I" + audit))
        if i < len(rows):
            first, gone, short = rows[i]
            cost, audit = best(i + 1, q, 2)
            ways.append((cost + 3, "D" + audit))
            if not gone:
                for r, to in NEXT[q].items():
                    cost, audit = best(i + 1, to, 2)
                    if r == first:
                        ways.append((cost + short, "K" + audit))
                    if r != "s":
                        ways.append((cost + 2 + short, "R" + audit))
        return min(ways, default=(10**9, ""))

    for i in range(len(rows), 0, -50):
        best(i, 0, 2)
    return best(0, start, 2)


def lettered(rows):
    return "".join("x" if gone else (f if f in "sua" else "o").upper() if short else (f if f in "sua" else "o") for f, gone, short in rows)


def some(rng, n):
    return [(rng.choice("suauauao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_search_finds_the_least_audit():
    rng = random.Random(3)
    for _ in range(3000):
        rows = some(rng, rng.randrange(0, 9))
        cost, audits = repair.search(lettered(rows), 0, repair.ACCEPTED)
        assert (cost, min(audits.values())) == cheapest(rows), rows


def test_segments_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        rows = some(rng, rng.randrange(3, 14))
        cut = rng.randrange(1, len(rows))
        labels = {0: (0, {0: ""})}
        for part in (rows[:cut], rows[cut:]):
            labels = repair.joined(labels, repair.passages(lettered(part)))
        ways = [labels[q] for q in repair.ACCEPTED if q in labels]
        least = min(c for c, _ in ways)
        assert (least, min(a for c, f in ways if c == least for a in f.values())) == cheapest(rows)


def expected(rows):
    """The query's rows by brute force, from (conv_id, turn, role, text)."""
    after, every = {}, set()
    for conv, turn, role, text in rows:
        every.add(conv)
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        after.setdefault(conv, []).extend([] if fault == 0 else [row, row] if fault == 3 else [row])
    out = []
    for conv in every:
        mine = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in mine if t is not None]
        seen, faults, codes = set(), [], []
        for _, role, text in mine:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
            codes.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = cheapest(codes)
        lines, q, k = [], 0, 0
        for e in audit:
            role, text = mine[k][1:] if e != "I" else ("", "")
            k += e != "I"
            if e != "D":
                first = role[:1] if e == "K" else "a" if q == 2 else "u"
                lines.append(f"{role if e == 'K' else {'a': 'assistant', 'u': 'user'}[first]}:{text}")
                q = NEXT[q][first]
        firsts = [r[:1] for _, r, _ in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(n) for n in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(rows):
    found, mended = repair.report(repair.damaged(rows), rows)
    return repair.beside(found, repair.digests(mended)).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_query_is_brute_force(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op13_conversation_repair"](spark, sf)
    assert got.columns == NAMES
    assert key(got.collect()) == key(expected(rows))


def test_long_conversation_in_segments(spark, monkeypatch):
    """Segments of three rows in many partitions, as the one search over all of it has it."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", "a b!", " ", f"n {t}."])) for c in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = key(expected(rows))
    assert key(run(df).collect()) == want
    marks = repair.diagnosed(repair.damaged(df)).withColumn("letter", repair._letter()).orderBy("conv_id", "turn", "h1", "h2", "id").collect()
    for c in (1, 2):
        letters = "".join(r.letter for r in marks if r.conv_id == c)
        labels = {0: (0, {0: ""})}
        for at in range(0, len(letters), 7):
            labels = repair.joined(labels, repair.passages(letters[at : at + 7]))
        ways = [labels[q] for q in repair.ACCEPTED if q in labels]
        least = min(x for x, _ in ways)
        assert (least, min(a for x, f in ways if x == least for a in f.values())) == next((r[6], r[7]) for r in want if r[0] == c)


def test_thousand_rows_of_one_conversation(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"line {t}.") for t in range(1500)] + [(8, 1, "user", "Hello.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert key(run(df).collect()) == key(expected(rows))


@pytest.mark.parametrize("extra", [False, True])
def test_defined_cases(spark, extra):
    rows = [(None, 1, "user", "A."), (None, None, None, None), (1, None, "user", "B."), (1, 2, "assistant", None), (2, 5, "", "C?"), (2, 5, "", "C?"), (2, 5, "", "C?"), (3, 1, "user", "x" * 300_000 + "."),
            (4, 1, None, ""), (5, 0, "system", "Only."), (6, 3, "user", "é…"), (6, 4, "assistant", "Ünd ."), (6, 9, "Assistant", "Z!\n\t ")]
    rows += [(c, 1, "user", "Hi.") for c in range(100, 140)]  # some of these lose their only row
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        for n in ("fault", "times", "h1", "letter", "initial", "audit", "cost", "place", "edit", "id", "r", "t", "__conv"):
            df = df.withColumn(n, F.lit("mine"))
    assert key(run(df).collect()) == key(expected(rows))
    assert run(df.where("false")).collect() == []
    assert canonical(run(df).toPandas()) == canonical(run(df.repartition(7)).toPandas())
