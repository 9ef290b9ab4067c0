"""Toxicity by compression distance, with a zstandard dictionary trained on toxic and one trained on ordinary text.

A text is cut into windows of a few words. Each window is compressed with either dictionary; how many bytes the toxic one saves beyond the
ordinary one is its margin. A score is a logistic function of how many windows, and what share, reach each margin threshold; thresholds' weights
are calibrated on labelled documents that the dictionaries were not trained on.

Both dictionaries are what zstandard's trainer makes of samples. Given whole toxic documents it keeps what is frequent, which in either kind of text is
the same common language; so contrast chooses its samples: of the words of toxic training documents those that hold a character run whose document
frequency is many times that in ordinary ones. Samples of the ordinary dictionary are windows of ordinary training documents. Both dictionaries are used
by their bytes and cut to one length, and windows begin with a fixed run of bytes that both hold: without it zstandard would store so short a block as
it is, and savings of a few bytes would not show.

``SAMPLE`` labelled ids of either kind at most, the first by hash of the id, fit all this on the driver, each by one whole text: the least of those that
share the id. Every text is scored, whole, in place.

Defined cases: null and empty texts score as texts without windows; words of more than ``PART`` characters are windows' words in overlapping parts; labels
with a null id or label are not used; with no toxic or no ordinary labelled text, or too little to train on, all scores are 0; equal texts have equal
scores; repeated rows get a score each; an empty table has none; other columns pass through, whatever their names, but for those named like a result,
which are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import pieces

#: Labelled ids of either kind that are used; half train dictionaries, half calibrate.
SAMPLE = 2400
#: Words of a window; characters of the parts of longer words, and how far one begins after the other.
WINDOW, PART, STEP = 3, 24, 12
#: Lengths of the character runs that are contrasted; how much commoner one has to be in toxic documents, and in what share of them it stands.
RUNS, TIMES, SHARE = (5, 6, 7), 20, 0.025
#: Share of toxic training documents in which a word stands that is a sample.
WORD_SHARE = 0.004
THRESHOLDS = (1, 2, 3, 4, 5, 7)
#: Bytes of a dictionary.
DICTIONARY = 1024
CARRIER = bytes(range(200, 224))
#: Scores from here on are toxic.
TOXIC = 0.7


def _runs(word: str) -> set[str]:
    return {word[i : i + n] for n in RUNS for i in range(len(word) - n + 1)}


def _tokens(text: str) -> list[str]:
    return text.lower().split()


def stems(toxic: list[str], ordinary: list[str]) -> list[str]:
    """What is many times commoner in toxic documents, most frequent first."""
    here: Counter = Counter()
    for t in toxic:
        here.update({g for w in set(_tokens(t)) for g in _runs(" " + w)})
    least = max(3, SHARE * len(toxic))
    here = Counter({g: k for g, k in here.items() if k >= least})
    there: Counter = Counter()
    for t in ordinary:
        there.update({g for w in set(_tokens(t)) for g in _runs(" " + w)} & here.keys())
    far = {g: k for g, k in here.items() if k / len(toxic) > TIMES * (there[g] + 0.5) / len(ordinary)}
    found: Counter = Counter()
    for t in toxic:
        own = set()
        for w in {" " + w for w in _tokens(t)}:
            marks = [(i, i + n) for n in RUNS for i in range(len(w) - n + 1) if w[i : i + n] in far]
            if marks:
                best = max(far[w[i:j]] for i, j in marks)
                marks = [(i, j) for i, j in marks if far[w[i:j]] >= 0.6 * best]
                own.add(w[min(i for i, _ in marks) : max(j for _, j in marks)])
        found.update(own)
    kept = [s for s, k in found.most_common() if k >= least]
    return [s for s in kept if not any(s != x and x in s for x in kept)]


def contrasting(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words of toxic documents that hold a contrasting stem, once for each document."""
    found = stems(toxic, ordinary)
    words = [w for t in toxic for w in sorted({" " + w for w in _tokens(t)}) if any(s in w for s in found)]
    often = Counter(words)
    return [w for w in words if often[w] >= WORD_SHARE * len(toxic)]


def windows(text: str | None) -> list[bytes]:
    words = _tokens(text or "")
    if any(len(w) > PART for w in words):
        words = [p for w in words for p in ([w] if len(w) <= PART else [w[i : i + PART] for i in range(0, len(w) - PART + STEP, STEP)])]
    return [(" " + " ".join(words[i : i + WINDOW])).encode() for i in range(0, len(words), WINDOW)]


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples, which are repeated where they are too few for the trainer; empty where that does not help."""
    for times in (1, 4, 16, 64):
        try:
            return zstandard.train_dictionary(DICTIONARY, samples * times).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


class Model:
    """Both dictionaries and the calibrated weights of the thresholds."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        half = lambda x: (x[::2], x[1::2])
        (t0, t1), (o0, o1) = half(toxic), half(ordinary)
        words = contrasting(t0, o0) if t0 and o0 else []
        bad = trained([w.encode() for w in words]) if words else b""
        good = trained([w for t in o0 for w in windows(t)]) if bad else b""
        n = min(len(bad), len(good))
        bad, good = bad[len(bad) - n :], good[len(good) - n :]
        self.contents = (good + CARRIER, bad + CARRIER)
        self.weights = None
        if bad and t1 and o1:
            x = self.features(t1 + o1)
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            y = np.r_[np.ones(len(t1)), np.zeros(len(o1))]
            self.weights = _fit((x - self.mean) / self.scale, y)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters(
            window_log=12, hash_log=11, chain_log=11, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        made = []
        for content in self.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return made

    def features(self, texts: list[str | None]) -> np.ndarray:
        ordinary, toxic = (c.compress for c in self._compressors())
        out = np.zeros((len(texts), 2 * len(THRESHOLDS)))
        for d, text in enumerate(texts):
            own = [CARRIER + x for x in windows(text)]
            if own:
                margin = np.array([len(ordinary(x)) - len(toxic(x)) for x in own])
                reach = (margin[:, None] >= THRESHOLDS).sum(0)
                out[d] = np.r_[np.sqrt(reach / len(own)), np.log1p(reach)]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-(np.hstack([np.ones((len(x), 1)), x]) @ self.weights).clip(-30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's steps, with a ridge on all but the first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).where("__id is not null and y in (0, 1)").distinct()
    order = [F.xxhash64("__id"), F.col("__id")]
    some = known.where("y = 1").orderBy(*order).limit(sample).union(known.where("y = 0").orderBy(*order).limit(sample))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("t")).where("t is not null")
    rows = own.join(F.broadcast(some), "__id").groupBy("__id", "y").agg(F.min("t").alias("t")).collect()  # at most 2 * SAMPLE texts
    rows.sort(key=lambda r: (r["__id"], r["t"]))
    seen: set[str] = set()
    kinds: tuple[list[str], list[str]] = ([], [])
    for r in rows:
        if r["t"] not in seen:
            seen.add(r["t"])
            kinds[r["y"]].append(r["t"])
    return Model(kinds[1], kinds[0])


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (all if None) with ``score`` and ``predicted``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    made = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, len(keep)):
            p = shared.value.scores(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p), pa.array((p >= TOXIC).astype(np.int32))], schema=made)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
