"""Queries of problem 9."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir, table
from . import mixing as M


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, made once for the same documents and kept in the shared folder."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", "source", "text").cast("decimal(38,0)")).alias("k")).first()
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{row['n']}-{abs(int(row['k'] or 0))}"
    counted = M.with_tokens(docs).drop("text")
    try:
        spark.read.parquet(path)
    except AnalysisException:
        counted.write.mode("overwrite").parquet(path)
    return spark.read.schema(counted.schema).parquet(path)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    return M.mix(_counted(spark, d), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Reached shares beside the targets."""
    docs, targets = _counted(spark, d), table(spark, d, "mix_target")
    return M.shares(M.mix(docs, targets), docs, targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
