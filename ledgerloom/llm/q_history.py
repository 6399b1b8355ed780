"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import history as H


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return H.all_repeats(table(spark, d, "recon_record"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("record_a", "record_b")


def p5_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Per load: how many of its records repeat one of an earlier load."""
    return _pairs(spark, d).groupBy("load").agg(F.countDistinct("later").alias("repeats"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much the pairs share: full copies, and changed ones by tenths of coverage."""
    return _pairs(spark, d).groupBy("full", F.floor(F.col("coverage") * 10).alias("tenths")).agg(F.count(F.lit(1)).alias("pairs"))


QUERIES = {"p5_found": p5_found, "p5_by_load": p5_by_load, "p5_coverage": p5_coverage}

#: The same pairs by plain equality of the moment, for comparison; the paragraphs decide the rest alike on these tables.
_PAIRS = """
first_seen as (
  select id, min(struct_pack(ia := ingested_at, b := ingest_batch, org := org_id, kind := kind, am := amount_minor, s := raw['settled_at'],
    o := nullif(ltrim(regexp_extract(external_ids['order_id'], '([0-9]{3,})', 1), '0'), ''), p := nullif(ltrim(regexp_extract(external_ids['payment_id'], '([0-9]{3,})', 1), '0'), ''))) as r
  from recon_record where source = 'processor_recon' group by id),
pair as (
  select a.id as record_a, b.id as record_b, greatest(a.r.b, b.r.b) as load, case when a.r.b > b.r.b then a.id else b.id end as later from first_seen a join first_seen b
    on a.r.org = b.r.org and a.r.kind = b.r.kind and a.r.s = b.r.s and a.id < b.id
  where a.r.b <> b.r.b and abs(a.r.am - b.r.am) <= 5
    and (coalesce(a.r.o = b.r.o, false) or coalesce(a.r.p = b.r.p, false) or (coalesce(a.r.o = b.r.o, true) and coalesce(a.r.p = b.r.p, true))))
"""
SQL = {
    "p5_found": f"with {_PAIRS} select record_a, record_b from pair",
    "p5_by_load": f"with {_PAIRS} select load, count(distinct later) as repeats from pair group by load",
}
