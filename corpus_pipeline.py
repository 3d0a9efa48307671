"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. A row that a stage drops is gone for good.

Edge cases are those of the operators: null and empty texts are judged like others, extra columns are
carried, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, decontamination, exact_dedup, near_dedup, quality
from tidegauge.llm.common import cut, folds, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, fitted on the training folds' labels, rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), ~folds(3, 1)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest id of equal texts."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies."""
    return near_dedup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: The classifier can't be written as SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is materialised before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
