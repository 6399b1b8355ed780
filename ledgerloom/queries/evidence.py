"""Evidence queries, generated data, and report roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs as R
from ..operators import evidence as V
from ..operators import generate as G
from ..tables import table
from .analysis import _edges
from .matching import _OUTCOME, _views
from .scalars import _ENTITY_STEPS, _NOISE
from ..functions.money import RESIDUAL_EDGES, edge_band
from ..operators import matching as M

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ENTITY = f"array_to_string(list_filter(regexp_extract_all(replace(replace({_ENTITY_STEPS}, '&', ' and '), '/', ' '), '([a-z0-9]+)', 1), lambda t: not list_contains([{_NOISE}], t) and not regexp_full_match(t, '[0-9]+') and length(t) > 1), ' ')"


@query(f"""
select entity, id, amount_minor, rank from (select *, row_number() over (partition by entity order by ia desc, id) as rank from (
  select {_ENTITY} as entity, id, min(amount_minor) as amount_minor, min(ingested_at) as ia from recon_record where source = 'ledger' group by all)) where entity <> '' and rank <= 25""")
def counterparty_history(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recon_record").where("source = 'ledger'").groupBy("id", "counterparty").agg(F.min("amount_minor").alias("amount_minor"), F.min("ingested_at").alias("ia"))
    r = r.withColumn("e", R.canonical_entity("counterparty")).groupBy("id", "e").agg(F.min("amount_minor").alias("amount_minor"), F.min("ia").alias("ia"))
    return V.history(r, F.col("e"), [F.desc("ia"), "id"]).select("entity", "id", "amount_minor", F.col("rank").cast("bigint").alias("rank"))


@query()
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Positive and shifted negative pairs of reviewed matches, counted by label."""
    m = table(spark, d, "gt_match").select("group_id", "run_id", "settlement_utr").dropDuplicates(["group_id"]).where("settlement_utr is not null")
    return V.shifted_pairs(m, "group_id", "run_id", "settlement_utr").groupBy("is_match").agg(F.count(F.lit(1)).alias("pairs"))


_CASE = f"select id as case_id, kind || '|' || coalesce(true_category, '') as shape_key, true_category as category, {_edges('dollar_impact_minor', RESIDUAL_EDGES)} as band, deterministically_resolvable as r, run_id from (select distinct id, kind, true_category, dollar_impact_minor, deterministically_resolvable, run_id from gt_anomaly)"


@query(f"""
with c as ({_CASE}), lib as (select shape_key, category, band, case when r then 'accept' else 'route' end as action, run_id as contributor from c),
e as (select shape_key, min(struct_pack(a := -n, b := -t, action := action)) as x from (select shape_key, action, count(*) as n, count(distinct contributor) as t from lib group by all) group by shape_key),
f as (select category, band, min(struct_pack(a := -n, b := -t, action := action)) as x from (select category, band, action, count(*) as n, count(distinct contributor) as t from lib group by all) group by all)
select case_id, case when e.x is not null then 'shape' when f.x is not null then 'category' end as found_by, coalesce(e.x, f.x).action as action, -coalesce(e.x, f.x).a as occurrences, -coalesce(e.x, f.x).b as tenants
from c left join e using (shape_key) left join f using (category, band)""")
def pattern_recall(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gt_anomaly").select("id", "kind", "true_category", "dollar_impact_minor", "deterministically_resolvable", "run_id").distinct()
    c = a.select(F.col("id").alias("case_id"), F.concat("kind", F.lit("|"), F.coalesce("true_category", F.lit(""))).alias("shape_key"), F.col("true_category").alias("category"), edge_band("dollar_impact_minor", RESIDUAL_EDGES).alias("band"), "deterministically_resolvable", "run_id")
    lib = c.select("shape_key", "category", "band", F.when(F.col("deterministically_resolvable"), "accept").otherwise("route").alias("action"), F.col("run_id").alias("contributor"))
    return V.recall_patterns(c.select("case_id", "shape_key", "category", "band"), lib)


@query("""
with t as (select (residual_minor is not null and abs(residual_minor) <= 100)::int as tied, abs(expected_minor) as m, (spec_version >= 4)::int as half from (select distinct group_id, run_id, residual_minor, expected_minor from decomposition) join (select run_id, max(spec_version) as spec_version from recon_run group by run_id) using (run_id)),
s as (select half, round(avg(tied), 6) as recall, round(sum(tied * m)::double / sum(m), 6) as money_coverage, round(1 - avg(tied), 6) as false_match_rate from t group by half)
select b.metric, b.value as baseline, c.value as current, case when b.metric = 'false_match_rate' then round(c.value - b.value, 9) <= 0.005 when b.metric = 'money_coverage' then round(b.value - c.value, 9) <= 0.01 else round(b.value - c.value, 9) <= 0.02 end as ok
from (select * from s unpivot (value for metric in (recall, money_coverage, false_match_rate))) b join (select * from s unpivot (value for metric in (recall, money_coverage, false_match_rate))) c on b.metric = c.metric and b.half = 0 and c.half = 1""")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the current spec version against those of earlier ones."""
    versions = table(spark, d, "recon_run").groupBy("run_id").agg(F.max("spec_version").alias("version"))
    x = table(spark, d, "decomposition").select("group_id", "run_id", "residual_minor", "expected_minor").distinct().join(versions, "run_id")
    x = x.select(F.coalesce(F.abs("residual_minor") <= 100, F.lit(False)).cast("int").alias("tied"), F.abs("expected_minor").alias("m"), (F.col("version") >= 4).cast("int").alias("half"))
    s = x.groupBy("half").agg(F.round(F.avg("tied"), 6).alias("recall"), F.round(F.sum(F.col("tied") * F.col("m")) / F.sum("m"), 6).alias("money_coverage"), F.round(1 - F.avg("tied"), 6).alias("false_match_rate"))
    long = s.unpivot("half", ["recall", "money_coverage", "false_match_rate"], "metric", "value")
    return V.gate(long.where("half = 0"), long.where("half = 1"))


@query(f"""with {_OUTCOME}
select cast(sum(gross) as bigint) as gross, cast(sum(refunds) as bigint) as refunds, cast(sum(mdr) as bigint) as mdr, cast(sum(gst) as bigint) as gst, cast(sum(net) as bigint) as net,
  cast(sum(case when outcome in ('exact', 'tolerant') then net else 0 end) as bigint) as tied from named""")
def memo_rollup(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    x = M.outcome(b, c, led)
    return x.agg(*(F.sum(k).alias(k) for k in ("gross", "refunds", "mdr", "gst", "net")), F.sum(F.when(F.col("outcome").isin("exact", "tolerant"), F.col("net")).otherwise(0)).alias("tied"))


@query(f"with {_OUTCOME} select batch_key, n, net from named where dup")
def duplicate_payment(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)[1].where("dup").select("batch_key", "n", "net")


@query(f"with {_OUTCOME} select batch_key, gross, ledger_total, ledger_ok from named where not ledger_ok")
def ledger_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    return M.outcome(b, c, led).where("not ledger_ok").select("batch_key", "gross", "ledger_total", "ledger_ok")


@query()
def generated_batches(spark: SparkSession, d: str) -> DataFrame:
    """A generated dataset of as many orders as the orders table has rows: its batches tie to their credits."""
    n = table(spark, d, "orders").count()
    lines = G.processor_lines(G.orders(spark, n))
    return G.bank_credits(lines)


@query("select user_id, count(*) as n, sum(cast(event_type = 'error' as int)) as errors from events group by user_id having count(*) > 1")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors")).where("n > 1")
