"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import nearest as N


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return N.nearest(N.payouts(table(spark, d, "recon_record")), N.advices(table(spark, d, "credit_advice")), ["org_id", "account_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("lid").alias("record_id"), F.col("rid").alias("advice_id"))


def p6_payouts(spark: SparkSession, d: str) -> DataFrame:
    """Every payout, with its advice and distance or with none."""
    ids = N.payouts(table(spark, d, "recon_record")).select("lid").where("lid is not null").distinct()
    return ids.join(_pairs(spark, d), "lid", "left").select(F.col("lid").alias("record_id"), F.col("rid").alias("advice_id"), "distance_us")


QUERIES = {"p6_found": p6_found, "p6_payouts": p6_payouts}

_NEAR = """
pay as (
  select id, min(struct_pack(org_id := org_id, account_no := account_no, t := t, amount := amount)) as r from (
    select id, org_id, external_ids['account_no'] as account_no, make_timestamp(try_cast(raw['settled_at'] as bigint) * 1000000) as t, amount_minor as amount
    from recon_record where kind = 'transfer') group by id),
near as (
  select id as record_id, advice_id, abs(epoch_us(r.t) - epoch_us(advised_at)) as distance_us
  from pay join credit_advice a on a.org_id = r.org_id and a.account_no = r.account_no
    and abs(a.amount_minor - r.amount) <= 200 and abs(epoch_us(r.t) - epoch_us(a.advised_at)) <= 129600000000
  qualify row_number() over (partition by id order by distance_us, advice_id) = 1)
"""

SQL = {
    "p6_found": f"with {_NEAR} select record_id, advice_id from near",
    "p6_payouts": f"with {_NEAR} select pay.id as record_id, advice_id, distance_us from pay left join near on pay.id = near.record_id",
}
