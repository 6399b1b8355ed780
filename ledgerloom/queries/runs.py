"""Whole runs: the load pipeline, the followed event log, a tampered run beside the untampered one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tamper as T
from ..plans import pipeline
from ..streaming import tail
from ..tables import shared_dir, table

QUERIES = {}
SQL = {}


def pipeline_records(spark: SparkSession, d: str) -> DataFrame:
    """Canonical records of all waiting raw rows."""
    r = pipeline.run(spark, d).records
    return r.select("id", "org_id", "source", "kind", "amount_minor", "fee_minor", "tax_minor", "currency", "value_date", "settled_at", "counterparty", "reference")


def pipeline_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """What the pipeline could not load, with the reason of the stage that refused it."""
    return pipeline.run(spark, d).quarantined.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def event_stream_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest state per user, folded as a stream."""
    base = f"{shared_dir(spark).rstrip('/')}/follow-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = tail.follow(spark, f"{d}/[e]vents.parquet", schema, "user_id", ["ts", "event_id"], ["event_type", "value"])
    return tail.run_follow(stream, "user_id", ["ts", "event_id"], base)


def tamper_difference(spark: SparkSession, d: str) -> DataFrame:
    """One batch gets a repeated row and one an altered amount: what differs in the outcome."""
    x = table(spark, d, "decomposition").select("group_id", "run_id", "residual_minor").dropDuplicates(["group_id"])
    first = x.agg(F.min("group_id")).first()[0] or ""
    y = T.change(T.repeat_row(x, "group_id", first), "group_id", first, "residual_minor", F.col("residual_minor") + 500000)
    return T.verdict(x, y, ["group_id", "residual_minor"])


QUERIES.update(pipeline_records=pipeline_records, pipeline_quarantine=pipeline_quarantine, event_stream_state=event_stream_state, tamper_difference=tamper_difference)
SQL["event_stream_state"] = "select user_id, count(*) as events, arg_max(event_type, struct_pack(t := ts, i := event_id)) as event_type, arg_max(value, struct_pack(t := ts, i := event_id)) as value from events group by user_id"
