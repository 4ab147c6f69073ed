"""From raw documents to a mixed training corpus: toxicity, near duplicates, benchmark leaks, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents; further columns travel along. Decisions are made row by row, so rows
without doc_id and rows that repeat one are judged by their own text like all others. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airgate.llm.common import table, written
from airgate.llm.decontam import without_leaks
from airgate.llm.mixing import mixed
from airgate.llm.near_dup import without_near_duplicates
from airgate.llm.pii import redacted
from airgate.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go; it learns from the labels of the given documents.

    Null and empty texts are judged as texts without words.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the least doc_id (five-word shingles, 0.8).

    Of rows with one doc_id that with the least text hash stays, of equal rows one; rows without words all stay.
    """
    return without_near_duplicates(docs, shingle=5, least=80, of=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a test item go; null and empty texts hold none."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts and n_chars counted anew; every row stays, and null texts stay null."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, with its copy (1, 2, ...) and its source's target in words."""
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: SQL can express neither the classifier nor the sketches; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
