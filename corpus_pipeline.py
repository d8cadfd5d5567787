"""Corpus pipeline: quality classifier, quality rules, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept, and
returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import bpe, decontaminate, gam, rules, shingles
from loomwork.llm.shared import discard, scratch, scratch_path, table

#: Learned models and tokenisation have no SQL form; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the additive model takes for good; it learns from the labelled rows of its own input."""
    return gam.keep_good(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the decision list reject; it is learned from all labelled documents, as hardly a bad one is left in ``docs``."""
    return rules.keep_good(docs, rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, and of those no two texts that share 4 of 5 of their five-word shingles: the least doc_id stays."""
    return shingles.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; others stay as they are."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe encoding and decoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written in the shared folder and read again.

    A stage's scratch tables, and its input, are deleted when its output is
    written; the last stage's input stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
