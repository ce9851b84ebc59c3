"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact, pack.

Each stage takes what the one before kept. ``STAGES`` can be run apart, with Parquet between. A stage
first has the executors return what heap the one before has left.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, minhash, packing, quality, secrets
from gridloom.llm.common import SharedTables, collect_on_executors, table
from gridloom.llm.queries import tokenizer


def _on_freed_heaps(stage):
    """The stage, planned and run once the executors' garbage is collected."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_on_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@_on_freed_heaps
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives label 1."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


@_on_freed_heaps
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, minhash.Params(shingle=5))


@_on_freed_heaps
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_on_freed_heaps
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact_secrets(docs, length_col="n_chars")


@_on_freed_heaps
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of powers of two."""
    return packing.pack_power_of_two(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each earlier stage kept is a table in the shared folder."""
    with SharedTables(spark, "corpus-pipeline") as tables:
        docs = table(spark, sf_dir, "documents")
        for i, (_, stage) in enumerate(STAGES[:-1]):
            docs = tables.save(stage(spark, docs, sf_dir), f"stage-{i}")
            if i:
                tables.drop(f"stage-{i - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, MinHash, forest and tokenizer cannot be put in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None
