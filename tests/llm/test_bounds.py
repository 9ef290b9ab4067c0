"""What operators hold on the driver and in a task, where ids, items or rows repeat."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.llm import common, decontaminate, quality, sharding, toxicity

_BLOCK = """
import random, resource, sys
import numpy as np, pyarrow as pa
from scanweave.llm.decontaminate import Block, BLOCK_BYTES
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(50_000)]
texts, size = [], 0
while size < BLOCK_BYTES:
    texts.append(" ".join(rng.choices(words, k=200)))
    size += len(texts[-1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
block = Block([str(k) for k in range(len(texts))], pa.array(texts), 10)
block.rank(block.keys.view(np.int64), np.ones(len(block.keys), np.int64))
print(len(block.at), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_full_block_of_a_benchmark_is_small():
    """Peak memory of a full block, in a process of its own."""
    out = subprocess.run([sys.executable, "-c", _BLOCK], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    windows, mb = out.stdout.split()
    assert int(windows) > 500_000 and float(mb) < 500, out


def test_block_windows_and_owners():
    texts = ["a b c d e f", "x", "b c d e", "", "a b c d e f", "q r"]
    block = decontaminate.Block(["1", "2", "3", "4", None, "6"], pa.array(texts), 4)
    got = {b" ".join(block.text(k)).decode(): sorted(block.items(k)) for k in range(len(block.at))}
    assert got == {"a b c d": ["", "1"], "b c d e": ["", "1", "3"], "c d e f": ["", "1"], "x": ["2"], "q r": ["6"]}


def test_repeated_items_are_taken_once(spark):
    items = spark.createDataFrame([("7", "one two three four five six")] * 3000 + [("8", "x y")], "item_id string, text string")
    held = [b for b, _ in decontaminate.item_blocks(items, "item_id", "text", 4, block_bytes=10**6)]
    assert len(held) == 1 and len(held[0].ids) == 2
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "x y z"), (3, "y x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.hit_items) for r in decontaminate.benchmark_hits(docs, items, window=4).collect()}
    assert got == {1: (6, ["7"]), 2: (2, ["8"]), 3: (0, [])}


def test_fits_take_a_text_for_each_sampled_id(spark, monkeypatch):
    """Twenty thousand rows that share two ids; the driver gets a row for each."""
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (1, 0, 0)], "doc_id long, toxic int, quality int")
    seen = []
    monkeypatch.setattr(toxicity, "Model", lambda toxic, ordinary: seen.append((toxic, ordinary)))
    toxicity.fit(docs, labels, sample=5)
    assert seen == [(["text number 0"], ["text number 1"])]
    rows = []
    monkeypatch.setattr(quality, "Logistic", lambda x, y: rows.append((x.shape, sorted(y))))
    quality.fit(docs, labels)
    assert rows == [((2, quality.N_FEATURES), [0.0, 1.0])]


def test_slots_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 500)
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("en").alias("lang"))
    got = sharding.with_slots(sharding.kd_tree(docs, leaves=2))
    rows = got.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("k"), F.min("slot"), F.max("slot")).collect()
    assert sum(r.n for r in rows) == 4000 and all(r.n == r.k and (r[3], r[4]) == (0, r.n - 1) for r in rows)


def test_batches_are_bounded_by_bytes(spark):
    common.bounded_batches(spark)
    rows = spark.range(400).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    most = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").agg(F.max("n")).first()[0]
    assert most < 2 * common.BATCH_BYTES


@pytest.mark.parametrize("window", [3, 10])
def test_block_ranks_by_the_rarest(window):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdef"), int(rng.integers(1, 30)))) for _ in range(50)]
    block = decontaminate.Block([str(k) for k in range(50)], pa.array(texts), window)
    keys, sizes = block.keys.copy(), dict(zip(block.keys.tolist(), rng.integers(0, 5, len(block.keys)).tolist(), strict=True))
    shingle, n = block.shingle, len(block.at)
    options = []
    for k in range(n):
        size = min(int(block.lengths[k]), decontaminate.SHINGLE)
        options.append([(sizes[int(shingle[size][block.at[k] + j])], int(shingle[size][block.at[k] + j]), j) for j in range(int(block.lengths[k]) - size + 1)])
    block.rank(keys.view(np.int64), np.array([sizes[int(k)] for k in keys]))
    chosen = {int(w): int(o) for w, o in zip(block.window_of, block.offset, strict=True)}
    for k, own in enumerate(options):
        low = min(own)
        assert (k in chosen) == (low[0] > 0)
        if k in chosen:
            assert own[chosen[k]][:2] == low[:2]
