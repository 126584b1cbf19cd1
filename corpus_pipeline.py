"""A corpus from raw documents to packed sequences: each stage works on all that the stage before it kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolweave.llm import decontamination, ngram_join, packing, quality_rules, suffix_dedup
from poolweave.llm.shared import read, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and blank texts among them. Repeated rows are judged each for itself."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id, with all rows under that id. Rows
    without doc_id, and documents without words, stay."""
    return ngram_join.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document (of smaller doc_id) has are cut out; documents of nothing else
    go. Rows of one doc_id do not cut each other; rows without doc_id, null and blank texts stay as they are."""
    return suffix_dedup.cut(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go, whatever their doc_id; null texts hold none."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences: a null text is its end id alone, repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", contamination),
    ("packing", packed),
]
#: SQL cannot express the fit of the rules, suffixes, alignments or token ids; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another. Nothing but the last one's output is left in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    with scratch(spark) as work:
        for name, stage in STAGES[:-1]:
            docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        name, stage = STAGES[-1]
        return work.result(stage(spark, docs, sf_dir), name)
