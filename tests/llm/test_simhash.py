"""SimHash components against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanweave.llm import common, queries, simhash
from tests.conftest import canonical


def mark(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reached(marks, ids, radius=2):
    """The smallest id of each row's component, by comparing all with all."""
    m = np.array(marks, np.uint64)
    label = np.arange(len(m))
    near = [np.flatnonzero(np.bitwise_count(m ^ x) <= radius) for x in m]
    moved = True
    while moved:
        moved = False
        for k, js in enumerate(near):
            low = label[js].min()
            if (label[js] != low).any():
                label[js], moved = low, True
    out = {}
    for k, v in enumerate(label):
        if ids[k] is not None:
            out[v] = min(out.get(v, ids[k]), ids[k])
    return [out.get(v) for v in label]


@pytest.mark.parametrize("sf_name", ["sf0.001", "sf0.01"])
def test_query_is_brute_force(spark, sf, sf_name):
    sf = sf.replace("sf0.001", sf_name)
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    marks = [mark(r.text) for r in rows]
    want = sorted((r.doc_id, f"{m:016x}", c) for r, m, c in zip(rows, marks, reached(marks, [r.doc_id for r in rows]), strict=True))
    got = queries.queries()["op11_simhash_components"](spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for *_, c in want}) < len(want)


@pytest.mark.parametrize("tile", [4, 60, 2048])
def test_tiles_lose_no_link(spark, tile):
    """Chains of marks two bits apart and loose ones, in tiles of any number of parts and blocks."""
    rng = np.random.default_rng(5)
    marks = set()
    for _ in range(60):
        m = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            marks.add(m)
            for b in rng.choice(64, 2, replace=False):
                m ^= 1 << int(b)
    marks |= {(1 << k) - 1 for k in range(0, 65, 3)} | {0, 2**64 - 1}
    marks = sorted(marks)
    df = spark.createDataFrame([(int(np.uint64(m).astype(np.int64)),) for m in marks], "mark long")
    found = {(r.a, r.b) for r in simhash.links(df, len(marks), tile).collect()}
    label = {m: m for m in marks}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in found:
        a, b = a % 2**64, b % 2**64
        assert (a ^ b).bit_count() <= 2
        label[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(m) for m in marks] == reached(marks, marks)
    assert len(found) < 3 * len(marks)


def test_parts_follow_the_number():
    assert [simhash.parts_for(n) for n in (10, 20_000, 50_000, 1_000_000, 10**8, 10**10)] == [1, 1, 2, 4, 16, 16]
    for parts in (1, 2, 4, 8, 16):
        assert len(simhash._steps(parts)) == (1 + 2 * parts + 2 * parts + 4 * parts * (parts - 1) // 2 + 1) // 2


def test_defined_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "word " * 30), (4, "word " * 30), (5, " \t\n "), (6, "é" * 50 + " " + "long " * 2000), (7, "one two"), (8, "ONE\x0btwo"), (None, "only null ids have this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [mark(t) for _, t in rows]
    want = sorted(((d, f"{m:016x}", c) for (d, _), m, c in zip(rows, marks, reached(marks, [d for d, _ in rows]), strict=True)), key=str)
    for n in ("mark", "tile", "block", "marks", "label", "component_id", "fingerprint", "__mark", "__number", "step", "i", "x"):
        df = df.withColumn(n, F.lit("mine"))
    got = simhash.with_component(df)
    assert set(got.columns) == set(df.columns)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert got.where("mark = 'mine' and step = 'mine'").count() == len(rows)
    assert simhash.with_component(df.where("false")).collect() == []
    assert canonical(got.select("doc_id", "component_id").toPandas()) == canonical(simhash.with_component(df.repartition(5)).select("doc_id", "component_id").toPandas())


def test_stretches_do_not_matter(monkeypatch):
    text = " ".join(f"w{k % 37}x{k % 11}" for k in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text) == whole == mark(text)
