"""Quality by hierarchical empirical Bayes: evidence of the document, over the standing of its path, over that of its host.

A logistic classifier on bytes and words of a text gives each document its odds at the corpus-wide rate of good documents. Grouped sums of these
probabilities give rates by host and by path (a finer key inside a host). Rates of few documents are shrunk: a path's toward its host's, a host's
toward the global one, each by a strength that the spread between groups shows (method of moments). The prior odds in a document's score are
those of its path without the document itself, so that nothing counts twice.

Sums are combined before the shuffle; the tables of hosts and paths are written to the shared folder, so the planner broadcasts them only below
its threshold, and splits hot hosts in a sort-merge join above it.

``SAMPLE`` labelled ids, the first by hash of the id, fit the classifier; rates and scores cover all documents, whose evidence is written once.

Defined cases: a null text is an empty one; null hosts and paths are groups of their own; labels with a null id or label are not used; an id
that is labelled twice with one quality counts once, and of texts that share an id the least is the labelled one; with no labels, or labels of one kind, the classifier says nothing and all are kept; repeated rows get a score each;
very long texts are read whole; ties in the order of the sample go by the id; an empty table stays empty; input columns named like a result are
replaced, others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .common import inner_names, written

#: Labelled rows that the classifier is fitted on.
SAMPLE = 6000
#: Documents of this probability and more are kept.
THRESHOLD = 0.5
#: Strengths of shrinkage stay inside these bounds, in documents.
STRENGTH = (5.0, 1000.0)

_BYTE_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"*#$%&@^~+=", b"|<>{}[]\\/_", b"\n", b"'\"()-"]
_LUTS = np.zeros((len(_BYTE_GROUPS) + 1, 256))
for _k, _g in enumerate(_BYTE_GROUPS):
    _LUTS[_k, list(_g)] = 1
_LUTS[-1, 128:] = 1
N_FEATURES = len(_LUTS) + 5


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of bytes, and length, mean word length, repetition, words that end in symbols, long words."""
    w = W.words(column)
    n_docs = len(w.first) - 1
    sizes = np.array(pc.fill_null(pc.binary_length(column), 0).to_pylist(), np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros((n_docs, N_FEATURES))
    hashes = w.hashes()
    symbol = _LUTS[4, w.data[w.end - 1]] if len(w.end) else np.zeros(0)
    length = w.end - w.start
    for d in range(n_docs):
        a, b = ends[d] - sizes[d], ends[d]
        i, j = w.first[d], w.first[d + 1]
        if b > a:
            out[d, : len(_LUTS)] = _LUTS @ np.bincount(w.data[a:b], minlength=256) / (b - a)
        m = j - i
        if m:
            out[d, len(_LUTS) :] = (np.log1p(m), np.log(length[i:j].mean()), len(np.unique(hashes[i:j])) / m, symbol[i:j].mean(), (length[i:j] > 20).mean())
    return np.hstack([np.sqrt(out[:, : len(_LUTS)]), out[:, len(_LUTS) :]])


class Logistic:
    """Weights on standardised features, with a ridge; fitted by Newton's steps on the driver, on a bounded sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._input(x)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _input(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z**2])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self._input(x) @ self.weights).clip(-12, 12)))


def _mapped(docs: DataFrame, text: str, keep: list[str], name: str, kind: T.DataType, of) -> DataFrame:
    """``keep`` of ``docs`` and a column that ``of`` makes of each stretch of texts."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, kind)])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, len(keep)):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(of(b.column(len(keep))), made.field(len(keep)).type)], schema=made)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Logistic | None:
    some = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).dropna().distinct().orderBy(F.xxhash64("__id"), "__id", "y").limit(sample)
    known = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(some), "__id")
    known = known.groupBy("__id", "y").agg(F.min("t").alias("t"))  # at most SAMPLE texts, of which the driver gets numbers
    rows = _mapped(known, "t", ["y"], "x", T.ArrayType(T.DoubleType()), lambda c: features(c).tolist()).collect()
    y = np.array([r[0] for r in rows], float)
    return Logistic(np.array([r[1] for r in rows]), y) if 0 < y.sum() < len(y) else None


def evidence(docs: DataFrame, model: Logistic | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all if None) and ``evidence``, the classifier's probability of a good document."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "evidence"]
    if model is None:
        return docs.select(*keep, F.lit(1.0).alias("evidence"))
    return _mapped(docs, text, keep, "evidence", T.DoubleType(), lambda c: model.probability(features(c)))


def _strength(s: DataFrame, total: str, n: str, rate: str) -> float:
    """How many documents a group's prior is worth: the between-group variance left after that of sampling, by moments."""
    r = s.where(f"{n} > 1").agg(
        F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - F.col(rate), F.lit(2))).alias("q"), F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(rate) * (1 - F.col(rate))).alias("v")
    ).first()
    if not r["k"] or r["k"] < 2 or not r["v"]:
        return STRENGTH[1]
    within = r["v"] / r["n"]
    between = max((r["q"] - r["k"] * within) / r["n"], 1e-9)
    return float(np.clip(within / between - 1, *STRENGTH))


def site_rates(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float]:
    """``host, path, n, total, prior``: of each path its documents, their summed evidence and the shrunk rate of its host; the global rate; and
    the strength of a host's prior over a path."""
    paths = written(scored.groupBy(F.col(host).alias("h"), F.col(path).alias("p")).agg(F.count("*").alias("n"), F.sum("evidence").alias("total")), "paths")
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("total").alias("ht"))
    whole = hosts.agg(F.sum("ht"), F.sum("hn")).first()
    rate = float(np.clip(whole[0] / whole[1], 1e-3, 1 - 1e-3)) if whole[1] else 0.5
    k = _strength(hosts.withColumn("r", F.lit(rate)), "ht", "hn", "r")
    hosts = hosts.select(F.col("h").alias("h2"), ((F.col("ht") + k * rate) / (F.col("hn") + k)).alias("prior"))
    both = written(paths.join(hosts, F.col("h").eqNullSafe(F.col("h2"))).drop("h2"), "sites")
    return both, rate, _strength(both, "total", "n", "prior")


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of ``docs`` (all if None) with ``evidence``, ``site_rate``, ``score`` and ``kept``."""
    made = {"evidence", "site_rate", "score", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    model = fit(docs, labels, id_col, text)
    scored = written(evidence(docs, model, text, keep=list(dict.fromkeys([*keep, host, path]))), "evidence")
    sites, rate, k = site_rates(scored, host, path)
    own_h, own_p, n, total, prior = inner_names(docs, "h", "p", "n", "total", "prior")
    sites = sites.select(F.col("h").alias(own_h), F.col("p").alias(own_p), F.col("n").alias(n), F.col("total").alias(total), F.col("prior").alias(prior))
    joined = scored.join(sites, F.col(host).eqNullSafe(F.col(own_h)) & F.col(path).eqNullSafe(F.col(own_p)), "left")
    site = (F.greatest(F.col(total) - F.col("evidence"), F.lit(0.0)) + k * F.col(prior)) / (F.col(n) - 1 + k)
    site = F.least(F.greatest(site, F.lit(1e-3)), F.lit(1 - 1e-3))
    logit = lambda p: F.log(p / (1 - p))
    own = F.least(F.greatest("evidence", F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(logit(own) + logit(F.col("site_rate")) - F.lit(float(np.log(rate / (1 - rate)))))))
    out = joined.withColumn("site_rate", site).withColumn("score", score if model else F.lit(1.0))
    return out.select(*keep, "evidence", "site_rate", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return with_quality(docs, labels, **columns).where("kept").select(*docs.columns)
