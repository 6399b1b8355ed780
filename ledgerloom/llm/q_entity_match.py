"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import entity_match as M

#: A pair is reported as a match from this marginal on; above one half at most one partner can qualify.
ACCEPT = 0.5


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_confidence(spark, d).where(F.col("confidence") > ACCEPT).select("bank_line_id", "record_id")


def p2_confidence(spark: SparkSession, d: str) -> DataFrame:
    return M.match(table(spark, d, "bank_line"), table(spark, d, "recon_record"))


QUERIES = {"p2_found": p2_found, "p2_confidence": p2_confidence}
SQL: dict[str, str] = {}
