"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, gif, html, jaccard, oracle, packing, pii, quotes, secrets, suffixes, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    every = (op1_suffixes, op2_secrets, op3_decontamination, op4_packing, op5_html, op6_toxicity, op7_jaccard, op8_quotes, op9_pii, op10_gif)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The others are not plain SQL; tests/llm holds them against brute force, round trips and held-out labels."""
    return {"op2_secrets": oracle.secrets_sql(), "op3_decontamination": oracle.contamination_sql(), "op7_jaccard": oracle.classes_sql(), "op8_quotes": oracle.threads_sql()}
