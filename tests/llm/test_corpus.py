"""The corpus operators against SQL, brute force, exact round trips and held-out accuracy; and the cases their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.llm import common, decontaminate, lines, mpeg, neardup, packing, quality, queries, sharding, substrings, toxicity, warc
from scanweave.llm import words as W
from tests.conftest import canonical

Q, S = queries.queries(), queries.oracle_sql()
ODD = [(1, "a b c", "x", "en"), (1, "a b c", "x", "en"), (2, None, None, None), (3, "", "x", "en"), (None, "word " * 30, "x", "de"), (4, "word " * 30, "y", None), (5, " \t\n ", "", "fr"), (6, "é" * 50 + " " + "long " * 20_000, "x", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string")
    for name in ("n_words", "score", "kept", "node", "label", "k", "size", "value", "place", "media", "class_id", "doc", "same", "t1", "key", "n", "lead", "maybe", "__doc", "__t1", "__maybe", "__byte", "__host", "__drop", "__h", "__n", "host", "h", "p"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(S))
def test_matches_sql(name, spark, duck, sf):
    got, want = Q[name](spark, sf).toPandas(), duck.sql(S[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_words_and_hashes():
    texts = ["Ab c\td", "", None, "é x  y\n", "a" * 10]
    w = W.words(pa.array(texts))
    assert [[w.text(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(5)] == [["Ab", "c", "d"], [], [], ["é x", "y"], ["a" * 10]]
    two = W.words(pa.array(["x y z", "q x y z r"]))
    h = two.hashes()
    assert W.range_hash(h, np.array([0]), np.array([3]), 1) == W.range_hash(h, np.array([4]), np.array([7]), 1)
    assert (W.words(pa.array(["AB c"]), W.ALNUM, lower=True).data[:2] == [97, 98]).all()


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "c", "def"], k=500))
    a = W.words(pa.array([text])).hashes()
    monkeypatch.setattr(W, "PIECE", 50)
    assert (W.words(pa.array([text])).hashes() == a).all()


# 1

def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = Q["op1_toxicity"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    rank = rows.score.rank()
    n = rows.toxic.sum()
    auc = (rank[rows.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))
    assert auc > 0.8 and rows.toxic[rows.predicted == 1].mean() > 0.8
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_scores_from_freshly_made_dictionaries(spark, sf):
    """Brute force: window by window with compressors of the test's own, from dictionaries that are trained anew."""
    import zstandard

    docs = common.table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    labels = common.table(spark, sf.replace("sf0.001", "sf0.01"), "labels").where(~toxicity.held_out())
    got = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels), keep=["doc_id"]).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    order = [r[0] for r in labels.where("toxic is not null").select("doc_id").distinct().orderBy("doc_id").collect()]
    kind = {r.doc_id: r.toxic for r in labels.collect()}
    known = [[t for t in dict.fromkeys(text[d] for d in order if d in text and text[d] is not None) if kind[next(i for i in order if text.get(i) == t)] == k] for k in (0, 1)]
    (o0, o1), (t0, t1) = ((x[::2], x[1::2]) for x in known)
    stem = toxicity.stems(t0, o0)
    words = [w for t in t0 for w in sorted({" " + w for w in t.lower().split()}) if any(s in w for s in stem)]
    words = [w.encode() for w in words if words.count(w) >= toxicity.WORD_SHARE * len(t0)]

    def cut(t):
        w = [p for x in (t or "").lower().split() for p in ([x] if len(x) <= 24 else [x[i : i + 24] for i in range(0, len(x) - 12, 12)])]
        return [(" " + " ".join(w[i : i + 3])).encode() for i in range(0, len(w), 3)]

    bad, good = toxicity.trained(words), toxicity.trained([w for t in o0 for w in cut(t)])
    n = min(len(bad), len(good))
    how = zstandard.ZstdCompressionParameters(window_log=12, hash_log=11, chain_log=11, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    with_ = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d[len(d) - n :] + toxicity.CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
    a, b = with_(good), with_(bad)

    def numbers(t):
        m = [len(a.compress(toxicity.CARRIER + w)) - len(b.compress(toxicity.CARRIER + w)) for w in cut(t)]
        reach = [sum(x >= k for x in m) for k in toxicity.THRESHOLDS]
        return [(r / max(1, len(m))) ** 0.5 for r in reach] + [np.log1p(r) for r in reach]

    x = np.array([numbers(t) for t in t1 + o1])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = toxicity._fit((x - mean) / scale, np.r_[np.ones(len(t1)), np.zeros(len(o1))])
    assert len(words) > 5 and n > 200
    for d in sorted(text)[:300]:
        z = np.r_[1, (np.array(numbers(text[d])) - mean) / scale] @ w
        assert abs(got[d] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_long_words_do_not_hide_others():
    plain = toxicity.windows("x" * 50)
    assert plain == [b" " + b" ".join([b"x" * 24] * 3), b" " + b"x" * 14] and max(map(len, toxicity.windows("a" * 100_000 + " idiot"))) <= 75
    assert any(b"idiot" in w for w in toxicity.windows("q" * 21 + "idiot" + "q" * 30)) and toxicity.windows(None) == []


def test_toxicity_defined_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.scored(odd, model).count() == len(ODD)
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert toxicity.scored(odd, toxicity.fit(odd, labels.where("false"))).agg(F.max("score")).first()[0] == 0


def test_held_out_is_crc(spark):
    rows = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


# 2

def test_cover_has_every_difference():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + k) % substrings.PERIOD in substrings.COVER and (j + k) % substrings.PERIOD in substrings.COVER for k in range(substrings.PERIOD))


def removal(docs):
    """Kept words of each (id, text) by the definition."""
    seen = defaultdict(list)
    for d, t in docs:
        w = (t or "").split(" ") if t else []
        for s in range(len(w) - 19):
            seen[tuple(w[s : s + 20])].append((d, s))
    first = {k: min(v) for k, v in seen.items()}
    out = []
    for d, t in docs:
        w = t.split(" ") if t else []
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (d, s) for p in range(s, s + 20)}
        out.append((d, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    block = [rng.choices("abcdefgh", k=60) for _ in range(4)]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(block)
            i = rng.randrange(0, 30)
            w += b[i : i + rng.randrange(5, 60)] + rng.choices("uvwxyz", k=rng.randrange(0, 9))
        docs.append((d, " ".join(w)))
    docs += [(90, docs[3][1]), (91, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.text) for r in substrings.without_repeats(df).collect())
    assert got == sorted(removal(docs))


def test_substrings_defined_cases(odd, nothing):
    rows = substrings.without_repeats(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[None].n_removed == 29 and by[4].n_removed == 30 and by[2].n_words == 0 and by[1].n_removed == 0 and by[6].n_removed > 19_000
    assert substrings.without_repeats(nothing).count() == 0


def test_substrings_of_rows_that_share_an_id(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    docs = [(d, f"{words(c, 300)} {words('same', 40)}") for d, c in ((None, "a"), (7, "b"), (9, "c"))] + [(None, words("d", 25)), (7, words("e", 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.text) for r in substrings.without_repeats(df).collect()}
    assert got == {docs[0], (7, words("b", 300)), (9, words("c", 300)), docs[3], docs[4]}


def test_substrings_with_many_null_ids_and_inner_names(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    docs = [(None if k % 3 else k, f"{words(f'n{k}_', 30)} {words('same', 25)} {words(f'm{k}_', k)}") for k in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    names = ["doc", "same", "places", "of", "at", "__text", "__row", "__doc", "row", "a", "b", "place", "t1", "first", "gone"]
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    rows = substrings.without_repeats(df).collect()
    assert len(rows) == 90 and all(r[n] == "mine" for r in rows for n in names)
    # null ids are one document that comes first; its windows at equal places are not earlier than one another
    assert all(r.n_removed == (25 if r.doc_id is not None else 0) for r in rows)


# 3

def test_warc_round_trip(spark):
    big, mark = "x" * 1500, "\r\n\r\nWARC/1.1\r\n" + "y" * 1200 + "\r\n"
    rows = [(1, "http://a", big), (2, "http://b\r\nc", big), (3, None, mark), (4, "u", None), (5, "u", "tiny"), (6, "u", "tiny"), (None, "u", big), (2, "u", big), (7, "ü", "é" * 600 + "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.archived(df.withColumn("payload", F.lit("mine"))).collect()
    assert len(back) == len(rows)
    kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in back)
    assert kinds == Counter([(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 2), (7, "response", None)])
    payload = {r.record_id: bytes(r.payload) for r in back if r.record_type == "response"}
    assert payload[3] == mark.encode() and payload[4] == b"" and payload[7] == rows[8][2].encode()
    assert {(r.record_id, r.payload_digest) for r in back} == {(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert next(r.url for r in back if r.record_id == 3) is None
    assert warc.archived(df.where("false")).count() == 0


# 4

def test_lines_defined_cases(spark, odd, nothing):
    assert lines.without_boilerplate(odd).count() == len(ODD) and lines.without_boilerplate(nothing).count() == 0
    rows = [(k, "h" if k < 9 else None, f"menu \r\nown {k}\n\nmenu") for k in range(12)] + [(20, "h", None)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = {r.doc_id: r for r in lines.without_boilerplate(df).collect()}
    assert got[0].text == "own 0\n" and got[0].n_dropped == 2 and got[11].n_dropped == 2 and got[20].text is None and got[20].n_lines == 0


def test_lines_use_no_python(spark, sf):
    plan = Q["op4_line_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5

def test_decontamination_in_blocks(spark, sf):
    docs, items = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    want = {(r.doc_id, r.n_hit, tuple(sorted(r.hit_items))) for r in decontaminate.benchmark_hits(docs, items).collect()}
    small = decontaminate.benchmark_hits(docs, items, block_bytes=1500, part_words=7)
    got = {(r.doc_id, r.n_hit, tuple(sorted(r.hit_items))) for r in small.collect()}
    assert small.columns == decontaminate.benchmark_hits(docs, items).columns
    assert got == want and any(n for _, n, _ in want)


def test_parts_of_long_items_have_the_same_windows():
    text = " ".join(f"w{k}" for k in range(57))
    for n in (1, 7, 47, 48, 57, 99):
        made = pa.Table.from_batches(decontaminate._parts(10, n)(iter([pa.RecordBatch.from_pydict({"id": ["a", "b", "c"], "text": [text, "x y", "!"]})]))).to_pylist()
        windows = {tuple(w[i : i + 10]) for r in made if r["id"] == "a" for w in [r["text"].split()] for i in range(len(w) - 9)}
        assert windows == {tuple(text.split()[i : i + 10]) for i in range(48)} and [r["text"] for r in made if r["id"] != "a"] == ["x y"]
        assert all(len(r["text"].split()) >= 10 for r in made if r["id"] == "a")


def test_decontamination_defined_cases(spark, odd, nothing):
    items = spark.createDataFrame([(1, "A-B c"), (1, "long " * 12), (None, "word"), (7, None), (8, "!!")], "item_id long, text string")
    got = {(r.doc_id, tuple(sorted(r.hit_items))) for r in decontaminate.benchmark_hits(odd, items).collect()}
    assert {(1, ("1",)), (2, ()), (4, ("",)), (6, ("1",))} <= got
    assert decontaminate.benchmark_hits(nothing, items).count() == 0
    assert {r.n_hit for r in decontaminate.benchmark_hits(odd, items.where("false")).collect()} == {0}


# 6

def exact_classes(docs):
    sets = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) if t and t.split() else t for d, t in docs}
    up = {d: d for d, _ in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(up)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or isinstance(x, frozenset) and isinstance(y, frozenset) and len(x & y) >= 0.8 * len(x | y):
                a2, b2 = top(a), top(b)
                up[max(a2, b2)] = min(a2, b2)
    return {d: top(d) for d in ids}


def edited(rng, words, rate):
    return " ".join(w if rng.random() > rate else rng.choice("pqrstuv") + w for w in words)


def test_classes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    docs = [(k, edited(rng, base[k % 6], rng.random() * 0.06)) for k in range(150)]
    docs += [(500 + k, docs[k][1]) for k in range(10)] + [(900, "a b"), (901, "a  b"), (902, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.with_class(df).collect()}
    assert got == exact_classes(docs)
    kept = sorted(r.doc_id for r in neardup.one_of_each(df).collect())
    assert kept == sorted(set(got.values()))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = h[:900], h[100:]
    doc = np.r_[np.zeros(900, int), np.ones(900, int)]
    sig = neardup.signatures(doc, np.r_[a, b], np.ones(1800, int), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.04
    # weights: a shingle of twice the weight wins a register twice as often
    two = neardup.signatures(np.zeros(2, int), h[:2], np.array([1, round(np.e)]), 1, 4096)
    share = max(Counter(two[0].tolist()).values()) / 4096
    assert abs(share - (1 + np.log(3)) / (2 + np.log(3))) < 0.04


def probability_jaccard(x, y):
    both = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in x.keys() & y.keys())


def weights(text):
    w = text.split()
    return {k: 1 + np.log(n) for k, n in Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)).items()}


def test_exact_similarity():
    rng = random.Random(3)
    for _ in range(40):
        x, y = ({rng.randrange(30): rng.choice([1, 1, 1, 2, 5]) for _ in range(20)} for _ in "xy")
        read = lambda d: (np.array(sorted(d), np.uint64), None if set(d.values()) == {1} else np.array([float(d[k]) for k in sorted(d)]))
        want = probability_jaccard(x, y)
        got = neardup.similarity(read(x), read(y))
        assert abs(got - want) < 1e-12 or got == 0 and want < 0.8


def repeats(k, times):
    whole = " ".join(f"{k}w{i}" for i in range(84))
    return [(2 * k, whole), (2 * k + 1, whole + f" {' '.join(f'{k}r{i}' for i in range(14))}" * times)]


def test_repeated_lines_do_not_hide_copies(spark):
    docs = [d for k in range(60) for d in repeats(k, 10 if k < 30 else 100)]
    got = {r.doc_id: r.class_id for r in neardup.with_class(spark.createDataFrame(docs, "doc_id long, text string"), weighted=False).collect()}
    assert got == exact_classes(docs) == {d: d // 2 * 2 for d, _ in docs}


def test_weighted_classes_against_brute_force(spark):
    """The same shingles, some of them repeated: alike as sets, but not always by their weights."""
    docs = []
    for k in range(40):
        w = [f"{k}w{i}" for i in range(100)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[: 2 * k] * 3))]
    got = {r.doc_id: r.class_id for r in neardup.with_class(spark.createDataFrame(docs, "doc_id long, text string"), weighted=True).collect()}
    want = {}
    for (a, x), (b, y) in zip(docs[::2], docs[1::2], strict=True):
        want |= {a: a, b: a if probability_jaccard(weights(x), weights(y)) >= 0.8 else b}
    assert got == want and 5 < sum(d == c for d, c in want.items() if d % 2) < 35


def test_large_buckets_have_a_hub(spark, monkeypatch):
    """Copies of one text that are alike to it, but not to each other."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    docs = [(700, " ".join(base))]
    for k in range(80):
        at = set(range(k % 60, 300, 60))
        docs.append((k, " ".join(f"x{rng.random()}" if i in at else w for i, w in enumerate(base))))
    got = {r.doc_id: r.class_id for r in neardup.with_class(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == exact_classes(docs)


def test_classes_defined_cases(odd, nothing):
    rows = neardup.with_class(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.class_id for r in rows}
    assert by[2] == by[3] == 2 and by[4] == by[None] and by[5] == 5
    assert neardup.with_class(nothing).count() == 0 and neardup.one_of_each(odd).columns == odd.columns


def test_ids_do_not_join_classes(spark):
    rng = random.Random(7)
    u, v, x, y, z = ([f"{c}{rng.randrange(5000)}" for _ in range(120)] for c in "uvxyz")
    near = lambda w: " ".join([*w[:-1], "end"])
    docs = [(None, " ".join(u)), (None, " ".join(v)), (10, near(u)), (11, near(v)), (7, " ".join(x)), (7, " ".join(y)), (8, near(y)), (None, " ".join(z)), (None, near(z)), (9, "own"), (9, "own")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text): r.class_id for r in neardup.with_class(df).collect()}
    assert got == dict(zip(docs, (10, 11, 10, 11, 7, 7, 7, None, None, 9, 9), strict=True))
    kept = Counter((r.doc_id, r.text) for r in neardup.one_of_each(df).collect())
    null = [d for d in docs[7:9] if d in kept]
    assert len(null) == 1 and kept == Counter([docs[k] for k in (2, 3, 4, 5, 9)] + null)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)]
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == y for x, y in up.items())


# 7

def test_shards(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = Q["op7_kd_sharding"](spark, sf).toPandas()
    docs = common.table(spark, sf, "documents").toPandas().set_index("doc_id").text
    assert len(rows) == len(docs) and set(rows.shard) == set(range(16))
    assert all(zlib.crc32(docs[r.doc_id].encode()) == r.text_crc32 and len(docs[r.doc_id].encode()) + 1 == r.size for r in rows.itertuples())
    total = rows.groupby("shard")["size"].sum()
    assert total.max() < 1.1 * total.mean() and total.min() > 0.9 * total.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_one_text_is_split_by_id(spark):
    df = spark.range(1600).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    n = [r["count"] for r in sharding.kd_tree(df).groupBy("shard").count().collect()]
    assert len(n) == 16 and max(n) - min(n) <= 2


def test_leaves_reach_the_target(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"), F.lit("en").alias("lang"))
    sizes = [r[0] for r in sharding.kd_tree(df, target_bytes=13_000).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 13_000


def test_tree_by_brute_force(spark, sf):
    """Node by node over all points, as the docstring says it."""
    docs = common.table(spark, sf.replace("sf0.001", "sf0.01"), "documents").where("doc_id % 2 = 0")
    dims = [F.log2(F.length("text") + 1), F.crc32("lang")]
    points = [r.asDict() for r in sharding._points(docs, "doc_id", "text", dims).collect()]
    total, want = sum(p["size"] for p in points), {}

    def reach(rows, key, half, below):
        for v in sorted({p[key] for p in rows}):
            at = sum(p["size"] for p in rows if p[key] == v)
            if below + at >= half:
                return v, below, at
            below += at

    def split(rows, node):
        if node >= 8:
            want.update({p["id"]: node - 8 for p in rows})
            return
        wide = max(range(2), key=lambda k: max(p[f"k{k}"] for p in rows) - min(p[f"k{k}"] for p in rows))
        key, half = f"k{wide}", sum(p["size"] for p in rows) / 2
        v, below, at = reach(rows, key, half, 0)
        inner = -1 if half - below < below + at - half else 2**60
        if min(half - below, below + at - half) > sharding.TOLERANCE * total / 8:
            x, b, a = reach([p for p in rows if p[key] == v], "ki", half, below)
            inner = x - 1 if half - b < b + a - half else x
        left = [p[key] < v or p[key] == v and p["ki"] <= inner for p in rows]
        split([p for p, y in zip(rows, left, strict=True) if y], 2 * node)
        split([p for p, y in zip(rows, left, strict=True) if not y], 2 * node + 1)

    split(points, 1)
    assert {r.id: r.shard for r in sharding.kd_tree(docs, leaves=8, dims=dims).collect()} == want


def test_shards_defined_cases(odd, nothing):
    assert sharding.with_slots(sharding.kd_tree(odd)).count() == len(ODD) and sharding.with_slots(sharding.kd_tree(nothing)).count() == 0


# 8

@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tokens(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_pieces(rows, docs):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for d, text in docs.items():
        ids, at = tokens(text), 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    return pad


def test_packing(spark, sf):
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    rows = Q["op8_packing"](spark, sf).collect()
    assert check_pieces(rows, docs) < 0.03 * sum(r.length for r in rows)


def test_pieces_of_text_have_the_ids_of_whole_texts():
    import public_tokenizers

    known, rng = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    parts = ["a", "b", " ", " ", " ", "\n", "\t", "\r", "'", "s", "'s", "re", "1", ".", ",", "-", "é", "ñ", "\u3000", "\xa0", "\u2003", "\x85", "\x1c", "漢", "…", "<|endoftext|>", "\0", "\u0301", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(4000)]
    ids, n = known.of(pa.array([*texts, None]))
    at = np.append(0, np.cumsum(n))
    assert n[-1] == 0
    for k, t in enumerate(texts):
        assert known.tool.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist(), t


def test_packing_defined_cases(spark, odd, nothing):
    import public_tokenizers

    texts = [None, "", "a  b\n\n c", " x", "x ", "a\0b c", "<|endoftext|> a", "q" * 5000, "w " * 3000, "tab\t and\r\n more ", "  y　z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_pieces(packing.packed(df, path).collect(), dict(enumerate(texts)))
    assert packing.packed(nothing, path).count() == 0
    whole = packing.packed(odd.withColumn("start", F.lit("mine")).coalesce(1), path)
    assert whole.columns == [c for c in odd.columns if c != "text"] + packing.PIECE.names
    assert Counter(r.doc_id for r in whole.where("start = 0").collect()) == Counter(r[0] for r in ODD)


def cheapest(places, cost, size):
    best = [0] + [10**9] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = places[j] - places[i]
            if n <= size:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else size - n) + cost[j] + packing.SEQUENCE)
    return best[-1]


def test_cuts_are_the_best_over_the_whole_line():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = np.r_[0, np.cumsum(rng.integers(1, 20, 120))]
        cost = np.r_[0, rng.integers(0, 6, 120)]
        cuts, found = packing.Cuts(32), [0]
        for a in range(1, 121, 10):
            cuts.add(places[a : a + 10], cost[a : a + 10])
            found += cuts.settled(a == 111).tolist()[1:]
        price = dict(zip(places.tolist(), cost.tolist(), strict=True))
        total = sum((0 if (n := b - a) & (n - 1) == 0 else 32 - n) + price[b] + packing.SEQUENCE for a, b in zip(found, found[1:], strict=False))
        assert found[-1] == places[-1] and total == cheapest(places.tolist(), cost.tolist(), 32)


def test_cuts_beyond_the_horizon(monkeypatch):
    monkeypatch.setattr(packing, "HORIZON", 5)
    cuts = packing.Cuts(32)
    cuts.add(np.arange(7, 700, 7), np.zeros(99, int))
    assert cuts.settled()[-1] == 693 and cuts.place == [693]


# 9

def test_mpeg_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 575, 576, 577, 5000):
        data = rng.randbytes(n)
        media = mpeg.encode(data)
        s = mpeg.parse(media)
        assert mpeg.payload(s) == mpeg.padded(data) and s.tags["n_bytes"] == str(n) and s.damaged == 0 and s.skipped == 0
        assert s.table_frames == len(s.offsets) == len(mpeg.padded(data)) // 576 and s.samples == 1152 * len(s.offsets)


def test_mpeg_damage():
    media = mpeg.encode(bytes(range(256)) * 20)
    s = mpeg.parse(media)
    cut = media[: s.offsets[2]] + b"\xff\xfbgarbage" + media[s.offsets[2] :]
    t = mpeg.parse(cut)
    assert len(t.offsets) == len(s.offsets) and t.skipped == 9 and mpeg.payload(t) == mpeg.payload(s)
    bad = bytearray(media)
    bad[s.offsets[1] + 10] ^= 1
    assert mpeg.parse(bytes(bad)).damaged == 1
    assert mpeg.parse(media[:-5]).skipped > 0 and not mpeg.parse(b"no sound at all").offsets and not mpeg.parse(b"").offsets
    assert mpeg.parse(media + b"TAG" + bytes(125)).skipped == 0
    assert mpeg.header(b"\xff\xfd\xa4\x00").length == 576 and mpeg.header(b"\xff\xff\x10\x00").samples == 384 and mpeg.header(b"\xff\xf3\x10\xc0").samples == 576


def bitwise_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ b else 0)
    return c


def bits_of(data):
    return [b >> k & 1 for b in data for k in range(7, -1, -1)]


@pytest.mark.parametrize(("head", "covered", "body"), [(b"\xff\xfe\x40\x00", 256, bytes(range(1, 33))), (b"\xff\xfe\x40\x60", 16 * 4 + 16 * 4 + 64, bytes(range(1, 33))), (b"\xff\xfe\x40\xc0", 128, bytes(16)), (b"\xff\xfc\x10\xc0", 26, bytes(50)), (b"\xff\xfc\x10\xc0", 26 + 16, b"\xff" * 50), (b"\xff\xfc\xa0\x00", 2 * 94, bytes(50)), (b"\xff\xfc\xa0\x00", 2 * 94 + 120, b"\xff" * 50), (b"\xff\xf4\x80\xc0", 75, bytes(50))])
def test_checksums_of_layers_one_and_two(head, covered, body):
    h = mpeg.header(head)
    assert mpeg.checked_bits(head + b"\0\0" + body.ljust(64, b"\0"), h) == covered or h.layer == 1 and h.mode == 1
    n = mpeg.checked_bits(head + b"\0\0" + body.ljust(64, b"\0"), h)
    crc = bitwise_crc((bits_of(head[2:]) + bits_of(body.ljust(64, b"\0")))[: 16 + n])
    frame = (head + crc.to_bytes(2, "big") + body).ljust(h.length, b"\0")[: h.length]
    s = mpeg.parse(frame * 3)
    assert (s.checked, s.damaged, s.skipped) == (3, 0, 0) and s.seconds == 3 * mpeg.Fraction(h.samples, h.rate)
    bad = bytearray(frame * 3)
    bad[h.length + 7] ^= 0x40
    assert mpeg.parse(bytes(bad)).damaged == 1


def test_tags():
    sound = mpeg.encode(b"x")[len(mpeg._tag(1)) :]
    text = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    frames = b"\0\0\0\x06" + bytes(6) + text(b"TIT2", b"\x01" + "Lied ü".encode("utf-16")) + text(b"TXXX", b"\0who\0me")
    three = b"ID3\x03\0\x40" + mpeg._syncsafe(len(frames)) + frames
    two = b"ID3\x02\0\x80" + mpeg._syncsafe(12) + b"TT2\0\0\x05\0\xff\0\xe0bc"
    one = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30, b" ") + bytes(30) + b"1999" + bytes(31)
    s = mpeg.parse(three + sound)
    assert s.tags == {"TIT2": "Lied ü", "who": "me"} and s.skipped == 0 and len(s.offsets) == 1 and s.seek_error == 0
    assert mpeg.parse(two + sound).tags == {"TT2": "ÿàbc"}
    assert mpeg.parse(sound + one).tags == {"title": "Song", "artist": "Singer", "album": "", "year": "1999", "comment": ""}


def test_duration_of_changing_rates():
    a, b = b"\xff\xfb\x90\xc0", b"\xff\xfb\x94\xc0"
    s = mpeg.parse(b"".join(h.ljust(mpeg.header(h).length, b"\0") for h in (a, a, b, b, b)))
    assert s.seconds == mpeg.Fraction(2 * 1152, 44100) + mpeg.Fraction(3 * 1152, 48000)


def test_mpeg_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    for r in Q["op9_mpeg_audio"](spark, sf).collect():
        own = mpeg.padded(docs[r.doc_id])
        assert r.n_bytes == len(docs[r.doc_id]) and r.payload_sha256 == hashlib.sha256(own).hexdigest() and r.tail_crc32 == zlib.crc32(own[-32:])
        assert r.media_sha256 == hashlib.sha256(mpeg.encode(docs[r.doc_id])).hexdigest()


def test_mpeg_defined_cases(odd, nothing):
    assert mpeg.media_features(mpeg.media_column(odd)).count() == len(ODD) and mpeg.media_features(mpeg.media_column(nothing)).count() == 0


# 10

def test_quality_on_other_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    known = labels.where("doc_id % 2 = 0")
    rows = quality.with_quality(docs, known, keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = rows.quality == 1
    assert rows.kept[good].mean() > 0.99 and (~rows.kept[~good]).mean() > 0.95


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0.9)] * 400 + [("bad", "p", 0.1)] * 400 + [("tiny", "p", 0.0)]
    sites, rate, k = quality.site_rates(spark.createDataFrame(rows, "h string, p string, evidence double"), "h", "p")
    by = {r.h: r for r in sites.collect()}
    assert 0.45 < rate < 0.55 and by["big"].prior > 0.85 and by["bad"].prior < 0.15 and 0.2 < by["tiny"].prior < 0.5


def test_quality_by_brute_force(spark, sf):
    """Rates and scores from the classifier's evidence, site by site."""
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    rows = quality.with_quality(docs, labels, keep=["doc_id", "source", "lang"]).collect()
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.source, r.lang].append(r.evidence)
        hosts[r.source].append(r.evidence)
    whole = [r.evidence for r in rows]
    rate = min(max(np.mean(whole), 1e-3), 1 - 1e-3)

    def strength(groups, prior):
        big = {k: v for k, v in groups.items() if len(v) > 1}
        n = sum(map(len, big.values()))
        within = sum(len(v) * prior(k) * (1 - prior(k)) for k, v in big.items()) / n
        q = sum(len(v) * (np.mean(v) - prior(k)) ** 2 for k, v in big.items())
        return np.clip(within / max((q - len(big) * within) / n, 1e-9) - 1, *quality.STRENGTH)

    k = strength(hosts, lambda _: rate)
    prior = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in hosts.items()}
    k2 = strength(paths, lambda p: prior[p[0]])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        v = paths[r.source, r.lang]
        site = min(max((max(sum(v) - r.evidence, 0) + k2 * prior[r.source]) / (len(v) - 1 + k2), 1e-3), 1 - 1e-3)
        score = 1 / (1 + np.exp(-(logit(min(max(r.evidence, 1e-6), 1 - 1e-6)) + logit(site) - logit(rate))))
        assert abs(r.site_rate - site) < 1e-9 and abs(r.score - score) < 1e-9 and r.kept == (r.score >= quality.THRESHOLD)


def test_quality_defined_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (4, 1)], "doc_id long, quality int")
    assert quality.with_quality(odd, labels).count() == len(ODD) and quality.with_quality(nothing, labels).count() == 0
    assert quality.good_documents(odd, labels.where("false")).count() == len(ODD)


# pipeline

def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.table(spark, sf, "documents")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == seen["start"].columns
        seen[name] = docs
    n = {k: v.count() for k, v in seen.items()}
    assert n["start"] > n["quality"] == n["line_dedup"] >= n["near_dedup"] > n["decontamination"] > 0
    hit = decontaminate.benchmark_hits(seen["near_dedup"], common.table(spark, sf, "benchmark"))
    assert n["decontamination"] == hit.where("n_hit = 0").count()
    kept = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    before = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert set(kept) == set(exact_classes(list(before.items())).values())
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, seen["decontamination"], sf).collect(), {r.doc_id: r.text for r in seen["decontamination"].collect()})


def test_pipeline_defined_cases(spark, odd, nothing, sf):
    """Nulls, repeats, empty and long texts, clashing names, an empty table: no stage fails, or loses or adds columns."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, sf).collect()
            if docs is nothing:
                assert rows == []
            elif name == "near_dedup":
                assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == [(True, k) for k in (1, 2, 4, 5, 6)]
            elif name == "line_dedup":
                assert len(rows) == len(ODD)
            elif name == "packing":
                assert len({(r.doc_id, r.sequence_id, r.offset) for r in rows}) == len(rows) >= len(ODD)
        assert all(stage(spark, docs, sf).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
