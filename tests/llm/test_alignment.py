"""Alignment of two tokenizers against a plain version by Python's own lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.llm import alignment, common, queries
from tests.conftest import canonical

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Result of each text, by whole texts given to the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    name = {k: t for t, k in a.get_vocab().items()}
    order = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in order} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in order)}
    assert ByteLevel().decode(["Ġa"]) == " a"
    of_b = lambda k: bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    groups, held = [], []
    for t in texts:
        mine = []
        if t:
            ids = [(k, bytes(byte[c] for c in name[k])) for k in a.encode(" " + t, add_special_tokens=False).ids], [(k, of_b(k)) for k in b.encode(t)]
            if all(b"".join(x for _, x in side) == (" " + t).encode() for side in ids):
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in ids]
                both = sorted(set(ends[0]) & set(ends[1]))
                last = 0
                for e in both:
                    mine.append(tuple([k for (k, _), z in zip(side, end, strict=True) if last < z <= e] for side, end in zip(ids, ends, strict=True)))
                    last = e
        groups.append(mine)
        held.append(Counter((x, y) for g in mine for x in g[0] for y in g[1]))
    count = Counter(p for h in held for p in h)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, h in zip(groups, held, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(h.values()), sum(n for p, n in h.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in h.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def test_query_is_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True))
    got = queries.queries()["op12_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want


ODD = [None, "", " ", "  ", "a b", "a  b   c", "\n\n x", "<|endoftext|> and <s> <unk>", "▁x", "é́ 日本語テスト 🎉🎉", "x" * 3000, "aaaa" * 500 + " b", "tab\there", "don't  stop!!! ... 1234567890", "a b c", "\x00\x01\x1f", "a b", " lead", "trail ", "CamelCase_and_snake-99%"]


@pytest.mark.parametrize("size", [alignment.ROUND_BYTES, 2000])
def test_odd_texts_in_one_round_and_in_many(spark, size, monkeypatch):
    want = sorted(((k, *p) for k, p in enumerate(plain(ODD))), key=str)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    for n in ("n_a", "a", "b", "__number", "__a", "number", "part", "pair", "groups_sha256"):
        df = df.withColumn(n, F.lit("mine"))
    got = alignment.with_alignment(df, A, B, round_bytes=size)
    assert set(got.columns) == set(df.columns) | set(alignment.RESULT.names)
    assert sorted(map(tuple, got.select("doc_id", *alignment.RESULT.names).collect()), key=str) == want
    assert got.where("a = 'mine' and __number = 'mine'").count() == len(ODD)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat")], "doc_id long, text string")
    got = alignment.with_alignment(df, A, B).collect()
    assert len(got) == 3 and all(tuple(r)[2:] == plain(["the cat"] * 3)[0] for r in got)
    assert alignment.with_alignment(df.where("false"), A, B).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert canonical(alignment.with_alignment(only, A, B).select("n_a", "n_links").toPandas()) == [("0", "0")] * 2


def test_pieces_are_the_whole(monkeypatch):
    """Random texts of odd characters, by remembered pieces and whole."""
    rng = random.Random(8)
    a, b, _, _ = alignment._tools(A, B)
    import sentencepiece
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    signs = ["a", "B", "the", " ", " ", "  ", "\n", "'s", "1", "é", "́", "ß", "-", ".", " ", "　", "日", "🎉", "\t", "<|endoftext|>", " ", "\x85", "_", "'", "İ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(4000)]
    spaced, _, _ = alignment._spaced(pa.array(texts))
    ids, n = a.of(spaced)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(" " + t, add_special_tokens=False).ids for t in texts]
    ids, n = b.of(spaced)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [model.encode(t) for t in texts]


def test_stretches_of_links(monkeypatch):
    rng = np.random.default_rng(4)
    size = np.array([1, 2, 3, 5])
    table = alignment.Table.of([b"x" * s for s in size])
    docs = []
    for total in (1, 7, 300, 0, 40):
        sides = []
        for _ in range(2):
            ids = []
            while (left := total - int(size[ids].sum())) > 0:
                ids.append(int(rng.choice(np.flatnonzero(size <= left))))
            sides.append(np.array(ids, "<u4").tobytes())
        docs.append(sides)
    x = alignment.aligned(pa.array([d[0] for d in docs], pa.binary()), pa.array([d[1] for d in docs], pa.binary()), table, table)
    one = [np.concatenate(c) for c in zip(*((d, p, n) for d, p, n in alignment.distinct_links(x)), strict=True)]
    for most in (1, 5, 60):
        monkeypatch.setattr(alignment, "LINKS", most)
        other = [np.concatenate(c) for c in zip(*((d, p, n) for d, p, n in alignment.distinct_links(x)), strict=True)]
        assert all((a == b).all() for a, b in zip(one, other, strict=True))


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 500, 60_000) << 32 | rng.integers(0, 3000, 60_000))
    rows = []
    for part in np.unique((keys >> 32) // alignment.RANGE):
        sizes, bits, own = alignment.perfect(keys[(keys >> 32) // alignment.RANGE == part])
        rows.append((int(part), sizes, np.packbits(bits, bitorder="little").tobytes(), own.tobytes()))
    index = alignment.Index(rows)
    assert sorted(index.of(keys)) == list(range(len(keys))) and (index.keys[index.of(keys)] == keys).all()
    with pytest.raises(ValueError):
        index.of(np.array([499 << 32 | 9999]))


def test_tree_sum(spark):
    rows = [(p, t, np.array([p, t, 1], "<i8").tobytes()) for p in (0, 3) for t in range(p, 23)]
    got = {r.part: np.frombuffer(bytes(r.counts), "<i8").tolist() for r in alignment.tree_sum(spark.createDataFrame(rows, "part long, task long, counts binary"), 23, fan=3).collect()}
    assert got == {p: [p * (23 - p), sum(range(p, 23)), 23 - p] for p in (0, 3)}
