"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder), works on everything its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.  `run` writes every stage as Parquet
in the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import decontamination, near_dedup, packing, quality_rules, secret_scan, tokens
from traceloom.llm.shared import table
from traceloom.session import pin


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the standard quality policy."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near-duplicates: the one with the smallest id."""
    return near_dedup.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_leaks(docs, table(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where every piece of every document lies in sequences of at most 1,024 tokens."""
    return packing.place(pin(packing.cut(docs, tokens.vocabulary())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmarks),
    ("secret_scan", secrets),
    ("best_fit_packing", sequences),
]

#: SQL has neither the fingerprints nor the tokens; a test holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
