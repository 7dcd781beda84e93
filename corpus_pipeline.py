"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents:

1. quality       documents that the classifier rejects go
2. line_dedup    later copies of repeated line runs go from the texts; a document
                 that loses every line goes
3. near_copies   one document of each group of similar ones stays
4. benchmark     documents that hold a test item go
5. packing       token sequences: one row per piece

Nulls, empty texts, repeated rows and empty tables are treated as each
operator's docstring says.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import decontamination, jaccard_join, line_dedup, packing, quality_classifier
from loanlens.llm.common import bounded_batches, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bounded(stage: Stage) -> Stage:
    """The stage with Arrow batches of a bounded size: executors live through all
    stages, and what large batches once took is not given back."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_quality(docs, _table(spark, sf_dir, "labels"))


@_bounded
def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


@_bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(docs)


@_bounded
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@_bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_runs),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
