"""Event-log scans and checks, latest rows, and the score of exceptions against reviewed anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import exceptions as X
from ..tables import norm_key, table

QUERIES = {}
SQL = {}
#: Event types and the payload fields that each must have, with their types.
PAYLOADS = {"signup": "k int", "click": "k int", "view": "k int", "purchase": "k int"}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq from events where user_id % 10 in (1, 7)")
def event_scan(spark: SparkSession, d: str) -> DataFrame:
    """The events of some runs in the order of each run."""
    return E.scan(table(spark, d, "events"), F.col("user_id") % 10 == F.lit(1), F.col("user_id") % 10 == F.lit(7), by="user_id", order=["ts", "event_id"]).select("user_id", "event_id", "event_type", F.col("seq").cast("bigint").alias("seq"))


@query("""
select event_type, count(*) as events, count(*) filter (where why is not null) as refused, min(why) as why from (
  select event_type, case when event_type not in ('signup', 'click', 'view', 'purchase') then 'unknown type' when not json_valid(props) then 'no object' when try_cast(json_extract_string(props, '$.k') as integer) is null then 'field k' end as why from events)
group by event_type""")
def payload_validation(spark: SparkSession, d: str) -> DataFrame:
    """What an append would refuse, by type: types that are not known, payloads without their fields."""
    x = E.validated(table(spark, d, "events"), "event_type", "props", PAYLOADS)
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("refused").alias("refused"), F.min("refused").alias("why"))


@query("select org_id, run_id, period, started_at from (select *, row_number() over (partition by org_id order by started_at desc, run_id) as k from recon_run where status is not null) where k = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The latest run with a status of each tenant (ties: smaller run id): a reduction, no group is sorted."""
    r = table(spark, d, "recon_run").where("status is not null")
    best = F.min(F.struct((-F.unix_micros("started_at")).alias("t"), "run_id", "period", "started_at"))
    return r.groupBy("org_id").agg(best.alias("b")).select("org_id", "b.run_id", "b.period", "b.started_at")


_LADDER = """
lad as (
  select run_id, upper(trim(settlement_utr)) as utr, case when abs(residual_minor) <= 100 and ledger_crosscheck_ok then null when abs(residual_minor) <= 100 then 'PARTIAL_PAYMENT' when not ledger_crosscheck_ok then 'PARTIAL_PAYMENT'
    when abs(residual_minor) <= greatest(components.mdr + components.gst_on_mdr, 1) * 0.25 then 'FEE_DEDUCTION' else 'UNEXPLAINED' end as category
  from decomposition where residual_minor is not null and settlement_utr is not null),
exc as (select distinct run_id, utr, category from lad where category is not null and utr <> '')
"""


def _ladder(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions of the decomposed batches: what does not tie, by the residual ladder, and broken ledger checks."""
    x = table(spark, d, "decomposition").where("residual_minor is not null and settlement_utr is not null").withColumn("utr", norm_key("settlement_utr")).where("utr is not null")
    fees = F.col("components.mdr") + F.col("components.gst_on_mdr")
    category, _, _ = X.ladder(F.col("residual_minor"), fees, F.col("ledger_crosscheck_ok"), F.lit(False), F.col("expected_minor"))
    small = F.abs("residual_minor") <= X.ROUNDING
    kind = F.when(small & F.col("ledger_crosscheck_ok"), None).when(small, "PARTIAL_PAYMENT").otherwise(category)
    return x.select("run_id", "utr", kind.alias("category")).where("category is not null").distinct()


@query(f"with {_LADDER} select category, count(*) as batches from exc group by category")
def decomposed_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return _ladder(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("batches"))


@query(f"""with {_LADDER},
an as (select id, max(true_category) as true_category, any_value(record_ids) as ids from gt_anomaly where len(record_ids) > 0 group by id),
rec as (select distinct id as rid, run_id, upper(trim(external_ids['settlement_utr'])) as utr from recon_record where external_ids['settlement_utr'] is not null),
hit as (select an.id, max((e.category = an.true_category)::int) as ok from (select id, true_category, unnest(ids) as rid from an) an join rec using (rid) join exc e on e.run_id = rec.run_id and e.utr = rec.utr group by an.id)
select (select count(*) from an) as anomalies, count(*) as detected, cast(coalesce(sum(ok), 0) as bigint) as right_category, round(coalesce(sum(ok), 0)::double / nullif(count(*), 0), 4) as category_accuracy from hit""")
def scorecard_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed anomalies that an exception touches, and those of them with the right category."""
    an = table(spark, d, "gt_anomaly").where(F.size("record_ids") > 0).groupBy("id").agg(F.max("true_category").alias("true_category"), F.min("record_ids").alias("ids"))
    rec = table(spark, d, "recon_record").select(F.col("id").alias("rid"), "run_id", norm_key(F.element_at("external_ids", "settlement_utr")).alias("utr")).where("utr is not null").distinct()
    return X.score(an, rec, _ladder(spark, d))
