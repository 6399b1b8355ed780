"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import abuse as A


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and whether it is flagged."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    model = A.fit_model(docs, table(spark, d, "abuse_label"))
    return A.score_documents(docs, model).drop("text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.rates(p10_scores(spark, d))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
