"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import leaks as L


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return L.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: how many documents carry it or a passage of it, and the longest passage."""
    per = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("passage_words").alias("longest_passage"))
    return table(spark, d, "eval_item").select("item_id", "suite").join(per, "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaked_items": p8_leaked_items}
SQL: dict[str, str] = {}
