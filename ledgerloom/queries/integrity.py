"""Queries of problems 1, 3 and 4: unreadable rows, late records, dangling references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import references as R
from ..sources import quarantine as Q
from ..streaming import late as L
from ..tables import scratch, table, written


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return Q.classify_rows(table(spark, d, "raw_line"), table(spark, d, "source_file"), table(spark, d, "fx_rate"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return Q.quarantined(_classified(spark, d)).select("line_id", "reason")


def p1_row_quarantined(spark: SparkSession, d: str) -> DataFrame:
    return Q.quarantined(_classified(spark, d))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return Q.loaded(_classified(spark, d)).withColumns({c: F.to_json(c) for c in ("cells", "amounts", "dates")})


def p1_source_ingested(spark: SparkSession, d: str) -> DataFrame:
    return Q.per_file(_classified(spark, d))


#: Bytes of files in a micro-batch: at least, and for each partition of the state. Every micro-batch loads and commits
#: every partition, so their product must grow no faster than the input.
LEAST_BYTES, PARTITION_BYTES = 24_000_000, 500_000


def _streamed(spark: SparkSession, d: str) -> str:
    """The streaming operator run over all of recon_record; one folder per run below the shared one."""
    schema = table(spark, d, "recon_record").schema
    closes = table(spark, d, "period_close")
    most = max(LEAST_BYTES, PARTITION_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(disorder: str) -> str:
        base = scratch(spark, "late")
        # As a pattern, so that one file and a folder of part files both serve as a stream.
        records = spark.readStream.schema(schema).option("maxBytesPerTrigger", most).parquet(f"{d}/[r]econ_record.parquet")
        L.run_event_windows(records, closes, base, disorder)
        return base

    try:
        return run(L.DISORDER)
    except L.OutOfOrderError:
        # Files in no order at all: state is kept for as long as any of them may need it.
        return run("36500 days")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return L.with_lateness(table(spark, d, "recon_record"), table(spark, d, "period_close"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return L.diverted(spark, _streamed(spark, d)).select(F.col("id").alias("record_id"), "period")


def p3_stream_sums(spark: SparkSession, d: str) -> DataFrame:
    return L.aggregates(spark, _streamed(spark, d))


def p3_period_sums(spark: SparkSession, d: str) -> DataFrame:
    return L.period_sums(_timed(spark, d))


def p3_too_late(spark: SparkSession, d: str) -> DataFrame:
    return L.too_late(_timed(spark, d)).select("id", "org_id", "source", "period", "amount_minor", "ingested_at", "cutoff_at")


def p3_open_batches(spark: SparkSession, d: str) -> DataFrame:
    return L.open_batches(table(spark, d, "prior_batch"), table(spark, d, "recon_record"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ["recon_record", "decomposition", "gt_match", "gt_anomaly", "recon_run"]
    # Read twice below, so the wide maps of the records are read once.
    return R.orphans(written(R.reference_keys(*(table(spark, d, n) for n in names)), "references"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "missing_key")


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_row_quarantined": p1_row_quarantined,
    "p1_loaded": p1_loaded,
    "p1_source_ingested": p1_source_ingested,
    "p3_found": p3_found,
    "p3_period_sums": p3_period_sums,
    "p3_too_late": p3_too_late,
    "p3_open_batches": p3_open_batches,
    "p3_stream_sums": p3_stream_sums,
    "p4_found": p4_found,
    "p4_by_period": p4_by_period,
}

_FIRST = """
first_arrival as (
  select id, r.* from (
    select id, min(struct_pack(ingested_at := ingested_at, ingest_batch := ingest_batch, org_id := org_id, source := source,
      period := strftime(coalesce(value_date, settled_at), '%Y-%m'), amount_minor := amount_minor)) as r
    from recon_record where id is not null and ingested_at is not null group by id)),
timed as (
  select f.*, c.ends_at, c.cutoff_at from first_arrival f
  left join (select org_id, source, period, max(ends_at) as ends_at, max(cutoff_at) as cutoff_at from period_close group by all) c
  using (org_id, source, period))
"""

_SUMS = f"""with {_FIRST}
select org_id, source, period,
  count(*) filter (where cutoff_at is null or ingested_at <= least(cutoff_at, ends_at)) as n_first_closed,
  cast(coalesce(sum(coalesce(amount_minor, 0)) filter (where cutoff_at is null or ingested_at <= least(cutoff_at, ends_at)), 0) as bigint) as sum_first_closed,
  count(*) filter (where cutoff_at is null or ingested_at <= cutoff_at) as n_corrected,
  cast(coalesce(sum(coalesce(amount_minor, 0)) filter (where cutoff_at is null or ingested_at <= cutoff_at), 0) as bigint) as sum_corrected,
  count(*) filter (where ingested_at > cutoff_at) as n_too_late,
  cast(coalesce(sum(coalesce(amount_minor, 0)) filter (where ingested_at > cutoff_at), 0) as bigint) as sum_too_late
from timed where period is not null group by all"""

_ORPHANS = """
runs as (select run_id, max(org_id) as org_id, max(period) as period from recon_run group by run_id),
utrs as (select distinct org_id, upper(trim(external_ids['settlement_utr'])) as k from recon_record),
pays as (select distinct org_id, upper(trim(external_ids['payment_id'])) as k from recon_record where kind = 'payment'),
refs as (
  select 'utr' as link, r.org_id, 'decomposition' as ref_table, group_id as row_id, upper(trim(settlement_utr)) as missing_key, coalesce(r.period, 'unknown') as period from decomposition left join runs r using (run_id)
  union all select 'utr', r.org_id, 'gt_match', group_id, upper(trim(settlement_utr)), coalesce(r.period, 'unknown') from gt_match left join runs r using (run_id)
  union all select 'utr', r.org_id, 'gt_anomaly', id, upper(trim(settlement_utr)), coalesce(r.period, 'unknown') from gt_anomaly left join runs r using (run_id)
  union all select 'payment', org_id, 'recon_record', id, upper(trim(external_ids['payment_id'])), coalesce(strftime(coalesce(value_date, settled_at), '%Y-%m'), 'unknown')
    from recon_record where kind in ('refund', 'adjustment', 'chargeback')),
orphan as (
  select ref_table, row_id, missing_key, min(period) as period from refs x
  where missing_key <> ''
    and not exists (select 1 from utrs u where x.link = 'utr' and u.org_id = x.org_id and u.k = x.missing_key)
    and not exists (select 1 from pays p where x.link = 'payment' and p.org_id = x.org_id and p.k = x.missing_key)
  group by x.link, x.org_id, ref_table, row_id, missing_key)
"""

SQL = {
    "p3_found": f"with {_FIRST} select id as record_id, period from timed where ingested_at > cutoff_at",
    "p3_too_late": f"with {_FIRST} select id, org_id, source, period, amount_minor, ingested_at, cutoff_at from timed where ingested_at > cutoff_at",
    "p3_period_sums": _SUMS,
    "p3_stream_sums": _SUMS,
    "p3_open_batches": """
with prior as (select upper(trim(settlement_utr)) as settlement_utr, from_run_id, period, max(net_minor) as net_minor from prior_batch group by all),
credits as (
  select settlement_utr, min(struct_pack(a := ingested_at, b := id, c := amount_minor)) as c from (
    select upper(trim(external_ids['utr'])) as settlement_utr, ingested_at, id, amount_minor from recon_record where source = 'bank')
  where settlement_utr is not null group by 1)
select period, settlement_utr, from_run_id, net_minor, c.a as credited_at, c.c as credit_minor, c is null as still_open from prior left join credits using (settlement_utr)""",
    "p4_found": f"with {_ORPHANS} select ref_table, row_id, missing_key from orphan",
    "p4_by_period": f"with {_ORPHANS} select ref_table, period, count(*) as orphan_refs, count(distinct missing_key) as missing_keys from orphan group by all",
}
