"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of ``documents``.
``run`` writes what a stage returns as Parquet in the shared folder, and the next stage reads it from there, so a lost executor costs a stage at most.

Defined cases, each as its operator has it: a null text is judged as an empty one; a null id, source or language is a value of its own; rows that repeat
an id and text are one document for near-dedup, which keeps one of them, and rows of their own for the other stages; ties go to the least id, then to
the least hashes of the text; texts of any length are read whole; an empty table stays empty; further columns pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanweave.llm.common import bounded_batches, table, written
from scanweave.llm.decontaminate import clean_documents
from scanweave.llm.lines import without_boilerplate
from scanweave.llm.neardup import one_of_each
from scanweave.llm.packing import packed
from scanweave.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site's standing reject go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate on their source go out of the texts; every document stays."""
    return without_boilerplate(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    bounded_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    bounded_batches(spark)
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Classifier, signatures and tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
