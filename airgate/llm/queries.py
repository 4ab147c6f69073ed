"""The queries that apply each operator to its whole table, and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airgate.llm import centroids, mixing, periodic_runs, top_k
from airgate.llm.common import table
from airgate.llm.decontam import find_leaks
from airgate.llm.fingerprints import edited_fingerprints
from airgate.llm.html_blocks import extract_main_text
from airgate.llm.langid import identify_languages
from airgate.llm.near_dup import near_duplicates
from airgate.llm.pii import find_personal_data
from airgate.llm.token_counts import token_counts
from airgate.llm.toxicity import score_toxicity
from airgate.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, least=80, of=100)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.nearest_of_set(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = periodic_runs.with_repeated_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digest(periodic_runs.periodic_runs(edited))


#: DuckDB SQL by query.
ORACLE: dict[str, str] = {
    "op10_mixing": mixing.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_top_k": top_k.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
