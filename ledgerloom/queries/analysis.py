"""Exceptions, read models, learning, memory and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import refs as R
from ..functions.money import COUNT_EDGES, RESIDUAL_EDGES
from ..operators import cascade as C
from ..operators import events as E
from ..operators import exceptions as X
from ..operators import learning as L
from ..operators import matching as M
from ..operators import memory as Y
from ..operators import views as V
from ..operators.rules import Rule, first_match
from ..tables import table, written
from .matching import _CASCADE, POOLS_SQL, cascade

QUERIES = {}
SQL = {}
#: SQL of the queries over the whole cascade, with ``{pools}`` open.
POOLED = {}
PERIOD_END = "1998-11-30"
RULES = [
    Rule("small", "abs(residual_minor) <= 100 and not is_empty(settlement_utr)", "ROUNDING"),
    Rule("broken", "no_such_column > 1", "NEVER"),
    Rule("ledger", "ledger_crosscheck_ok == False and residual_minor != 0", "PARTIAL_PAYMENT"),
    Rule("band", "100 < abs(residual_minor) <= 5000 and residual_minor % 50 == 0", "FEE_DEDUCTION"),
]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: What a spec might say before the built-in ladder: an agreed bank charge.
SPEC_RULES = [Rule("r_bank_charge", "residual_minor == 150 and ledger_crosscheck_ok == True", "FEE_DEDUCTION")]


def _register(spark: SparkSession, d: str, pools: bool = True) -> tuple[C.Cascade, DataFrame]:
    """The cascade and its exceptions, each written once: the read models below read them several times."""
    lines = V.proc(spark, d)
    done = cascade(spark, d, pools)
    taken = done.batches.where("match_pass is not null and match_pass <> 'subset'").select("batch_key")
    pays = lines.where("kind = 'payment'").join(taken, "batch_key", "left_anti").join(done.payments, "payment_id", "left_anti")
    orders = table(spark, d, "orders").where("o_orderkey % 23 <> 0").select(F.col("o_orderkey").alias("order_id"))
    b = done.batches
    parts = [X.security(lines), X.residuals(b, SPEC_RULES), X.ledger_breaks(b), X.chargebacks(b), X.duplicates(b), X.missing_credits(b, PERIOD_END)]
    parts += [X.orphan_credits(done.credits, b, V.prior(spark, d)), X.unmapped_orders(pays.withColumn("order_id", F.col("batch_key")), orders)]
    return done, written(X.register(parts), "register")


_ID = "'exc_' || substr(sha256({p} || '|' || {s}), 1, 12)"
_REGISTER = f"""{_CASCADE},
res as (
  select batch_key, tied as residual, mdr + gst as fees, ledger_ok, has_fx, net from closed where match_pass is not null and abs(tied) > 100
  union all select batch_key, residual, mdr + gst, ledger_ok, has_fx, net from closed where match_pass is null and not dup and credit_id is not null),
step as (select *, case when residual = 150 and ledger_ok then 0 when has_fx and abs(residual) <= abs(net) * 0.02 then 1 when not ledger_ok then 2 when abs(residual) <= greatest(fees, 1) * 0.25 then 3 else 4 end as s from res),
open_payment as (select payment_id, batch_key, amount from proc where kind = 'payment' and batch_key not in (select batch_key from closed where match_pass is not null and match_pass <> 'subset') and payment_id not in (select payment_id from pool_payment)),
parts as (
  select 'security' as producer, payment_id as subject, min(batch_key) as batch_key, 'SECURITY_REVIEW' as category, 'rule:r_security_scan' as classified_by, max(abs(amount)) as impact, 1.0::double as confidence
    from proc where memo like 'ignore all previous instructions%' group by payment_id
  union all select 'residual', cast(batch_key as varchar), batch_key, ['FEE_DEDUCTION', 'FX_DIFFERENCE', 'PARTIAL_PAYMENT', 'FEE_DEDUCTION', 'UNEXPLAINED'][s + 1],
    ['rule:r_bank_charge', 'rule:fx_spread', 'unclassified', 'rule:fee_drift', 'unclassified'][s + 1], residual, [0.9, 0.75, 0.6, 0.7, null][s + 1] from step
  union all select 'ledger', cast(batch_key as varchar), batch_key, 'PARTIAL_PAYMENT', 'unclassified', case when tied <> 0 then tied else -1 end, null from closed where match_pass is not null and not ledger_ok and abs(tied) <= 100
  union all select 'chargeback', cast(batch_key as varchar), batch_key, 'CHARGEBACK', 'rule:r_chargeback', disputed, 0.85 from closed where match_pass is not null and disputed > 0
  union all select 'duplicate', cast(batch_key as varchar), batch_key, 'DUPLICATE', 'rule:repeated_payment', abs(net), 0.9 from closed where match_pass is null and dup
  union all select 'missing', cast(batch_key as varchar), batch_key, case when settled_at > date '{PERIOD_END}' or day(settled_at) <= 3 then 'TIMING' else 'WRONG_ACCOUNT' end, 'rule:no_credit', abs(net), 0.7 from closed where match_pass is null and not dup and credit_id is null
  union all select 'orphan', credit_id, null, case when ties then 'MISSING_UTR' when carried then 'TIMING' else 'UNEXPLAINED' end, case when ties then 'rule:amount_ties' when carried then 'rule:r_cross_period' else 'unclassified' end, abs(amount), case when ties then 0.7 when carried then 0.75 end from (
    select c.*, exists (select 1 from closed b where b.match_pass is null and b.net between c.amount - 100 and c.amount + 100) as ties,
      exists (select 1 from prior p where p.net_minor between c.amount - 100 and c.amount + 100) as carried from open_credit c)
  union all select 'unmapped', payment_id, min(batch_key), 'UNEXPLAINED', 'unclassified', max(abs(amount)), null from open_payment where batch_key not in (select o_orderkey from orders where o_orderkey % 23 <> 0) group by payment_id),
register as (select {_ID.format(p='producer', s='subject')} as exception_id, producer, subject, batch_key, category, classified_by, cast(impact as bigint) as impact, confidence from parts)
"""
_CLUSTER = f"""{_REGISTER},
keyed as (select *, replace(classified_by, 'rule:', '') as rule_id, case when impact < 0 then 'short' when impact > 0 then 'over' else 'flat' end as direction,
  case when abs(impact) < 100000 then '<₹1k' when abs(impact) < 1000000 then '₹1k–₹10k' when abs(impact) < 10000000 then '₹10k–₹1L' when abs(impact) < 100000000 then '₹1L–₹10L' else '₹10L+' end as band from register),
clusters as (select category, rule_id, direction, band, count(*) as count, cast(sum(abs(impact)) as bigint) as gross_impact, cast(sum(impact) as bigint) as net_impact,
  arg_min(exception_id, struct_pack(i := -abs(impact), e := exception_id)) as example_id from keyed group by all)
"""
_CASH = f"""with {_REGISTER},
worst as (select batch_key, arg_min(category, struct_pack(r := -case when category in ('CHARGEBACK', 'WRONG_ACCOUNT', 'PARTIAL_PAYMENT', 'DUPLICATE', 'MISSING_UTR', 'SECURITY_REVIEW') then 3 when category = 'TIMING' then 1 else 2 end, i := -abs(impact), e := exception_id)) as category
  from register where batch_key is not null group by batch_key)
select case when category = 'TIMING' then 'in_transit' when category in ('CHARGEBACK', 'WRONG_ACCOUNT', 'PARTIAL_PAYMENT', 'DUPLICATE', 'MISSING_UTR', 'SECURITY_REVIEW') then 'held'
    when category = 'UNEXPLAINED' or not (coalesce(abs(coalesce(tied, residual)) <= 100, false) and ledger_ok) then 'unexplained' else 'confirmed' end as bucket,
  count(*) as batches, cast(sum(net) as bigint) as net from closed left join worst using (batch_key) group by bucket"""


def _both(sql: str):
    """Two queries: the read model over the whole cascade, and over what the blocked pass left, which SQL can say.

    ``{pools}`` in the SQL stands for what the pool passes took; the tests put in what a plain loop finds, so that the
    first form is compared too.
    """

    def keep(f):
        full, keyed = (lambda spark, d, p=p: f(*_register(spark, d, p)) for p in (True, False))
        QUERIES[f.__name__], QUERIES[f.__name__ + "_before_pools"] = full, keyed
        POOLED[f.__name__], SQL[f.__name__ + "_before_pools"] = sql, sql.replace("{pools}", POOLS_SQL)
        return f

    return keep


@_both(f"with {_REGISTER} select * from register")
def exception_register(done: C.Cascade, register: DataFrame) -> DataFrame:
    return register


@_both(f"with {_REGISTER} select producer, category, count(*) as exceptions, cast(sum(abs(impact)) as bigint) as gross_impact from register group by all")
def exceptions_by_type(done: C.Cascade, register: DataFrame) -> DataFrame:
    return register.groupBy("producer", "category").agg(F.count(F.lit(1)).alias("exceptions"), F.sum(F.abs("impact")).alias("gross_impact"))


@_both(f"with {_REGISTER} select r.exception_id, b.credit_id from register r join bank b on b.utr = r.batch_key")
def exception_credits(done: C.Cascade, register: DataFrame) -> DataFrame:
    return X.linked_credits(register, done.credits)


@_both(f"with {_CLUSTER} select * from clusters")
def root_cause_clusters(done: C.Cascade, register: DataFrame) -> DataFrame:
    return X.clusters(register)


@_both(f"with {_CLUSTER} select count(*) as clusters, cast(sum(count) as bigint) as exceptions, cast(sum(gross_impact) as bigint) as gross_impact, cast(sum(net_impact) as bigint) as net_impact from clusters")
def cluster_summary(done: C.Cascade, register: DataFrame) -> DataFrame:
    return X.clusters(register).agg(F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("exceptions"), F.sum("gross_impact").alias("gross_impact"), F.sum("net_impact").alias("net_impact"))


@_both(_CASH)
def cash_position(done: C.Cascade, register: DataFrame) -> DataFrame:
    return X.cash_position(done.batches, register)


@_both(f"with {_REGISTER} select cast(coalesce(sum(case when category = 'FEE_DEDUCTION' then abs(impact) else 0 end), 0) as bigint) as money_found from register")
def money_found(done: C.Cascade, register: DataFrame) -> DataFrame:
    return register.agg(F.coalesce(F.sum(F.when(F.col("category") == "FEE_DEDUCTION", F.abs("impact")).otherwise(0)), F.lit(0)).cast("bigint").alias("money_found"))


@_both(f"with {_REGISTER} select producer, exception_id, impact, rank from (select *, row_number() over (partition by producer order by abs(impact) desc, exception_id) as rank from register) where rank <= 5")
def top_exceptions(done: C.Cascade, register: DataFrame) -> DataFrame:
    return X.top_exceptions(register, "producer", 5).select("producer", "exception_id", "impact", F.col("rank").cast("bigint").alias("rank"))


@query("""
with pay as (select id, min(external_ids['order_id']) as o from recon_record where kind = 'payment' and external_ids['order_id'] is not null group by id),
led as (select distinct external_ids['order_id'] as o from recon_record where source = 'ledger')
select count(*) as unmapped from pay where not exists (select 1 from led where led.o = pay.o)""")
def unmapped_order(spark: SparkSession, d: str) -> DataFrame:
    """Payments whose order no ledger Record names."""
    order = F.element_at("external_ids", "order_id").alias("order_id")
    r = table(spark, d, "recon_record")
    pay = r.where("kind = 'payment'").select(F.col("id").alias("payment_id"), order, F.col("amount_minor").alias("amount")).where("order_id is not null").groupBy("payment_id").agg(F.min("order_id").alias("order_id"), F.max("amount").alias("amount"))
    return X.unmapped_orders(pay, r.where("source = 'ledger'").select(order)).agg(F.count(F.lit(1)).alias("unmapped"))


@query("""
select external_ids['settlement_utr'] as utr, org_id, count(distinct id) as lines, cast(sum(abs(amount_minor)) as bigint) as disputed from (select distinct id, org_id, amount_minor, external_ids, kind from recon_record)
where (kind = 'chargeback' or external_ids['dispute_id'] is not null) and external_ids['settlement_utr'] is not null group by all""")
def chargeback_batches(spark: SparkSession, d: str) -> DataFrame:
    ext = lambda k: F.element_at("external_ids", k)
    r = table(spark, d, "recon_record").select("id", "org_id", "amount_minor", "kind", ext("dispute_id").alias("dispute"), ext("settlement_utr").alias("utr")).where("utr is not null and (kind = 'chargeback' or dispute is not null)").distinct()
    return r.groupBy("utr", "org_id").agg(F.countDistinct("id").alias("lines"), F.sum(F.abs("amount_minor")).alias("disputed"))


@query("""
with c as (select id as credit_id, min(upper(trim(external_ids['utr']))) as utr, min(amount_minor) as amount from recon_record where source = 'bank' group by id),
p as (select settlement_utr, from_run_id, max(net_minor) as net_minor from prior_batch group by all),
x as (select credit_id, 0 as how, p.* from c join p on c.utr = p.settlement_utr union all select credit_id, 1, p.* from c join p on abs(c.amount - p.net_minor) <= 200),
b as (select credit_id, min(struct_pack(how := how, r := from_run_id, u := settlement_utr, n := net_minor)) as b from x group by credit_id)
select credit_id, case when b.how = 0 then 'reference' else 'amount' end as tied_by, b.r as from_run_id, b.u as settlement_utr, b.n as net_minor from b""")
def carry_forward_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "recon_record").where("source = 'bank'").groupBy(F.col("id").alias("credit_id")).agg(F.min(F.upper(F.trim(F.element_at("external_ids", "utr")))).alias("utr"), F.min("amount_minor").alias("amount"))
    return X.carry_forward(c, table(spark, d, "prior_batch"))


@query("""
select group_id, run_id, residual_minor, case when abs(residual_minor) <= 100 and settlement_utr is not null and settlement_utr <> '' then 'ROUNDING'
  when ledger_crosscheck_ok = false and residual_minor <> 0 then 'PARTIAL_PAYMENT'
  when abs(residual_minor) > 100 and abs(residual_minor) <= 5000 and residual_minor % 50 = 0 then 'FEE_DEDUCTION' end as classification from decomposition""")
def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "decomposition")
    kind, _ = first_match(RULES, set(x.columns))
    return x.select("group_id", "run_id", "residual_minor", kind.alias("classification"))


@query("""
select id, source, kind, amount_minor from (select distinct id, source, kind, amount_minor from recon_record where source = 'processor_recon' and kind = 'refund' and amount_minor between -500000 and -100000) order by id limit 40""")
def evidence_query(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recon_record").where("source = 'processor_recon' and kind = 'refund' and amount_minor between -500000 and -100000")
    return r.select("id", "source", "kind", "amount_minor").distinct().orderBy("id").limit(40)


@query("""
select m.group_id, e.entity as reference_id, r.hit is not null as resolved from (select group_id, unnest(processor_entity_ids) as entity from gt_match) e join gt_match m using (group_id)
left join (select distinct external_ids['entity_id'] as entity, true as hit from recon_record union select distinct external_ids['payment_id'], true from recon_record where external_ids['payment_id'] is not null) r using (entity)""")
def grounding_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "gt_match").select("group_id", F.explode("processor_entity_ids").alias("reference_id"))
    ext = lambda k: F.element_at("external_ids", k).alias("reference_id")
    rec = table(spark, d, "recon_record")
    known = rec.select(ext("entity_id")).union(rec.select(ext("payment_id"))).where("reference_id is not null").distinct().withColumn("hit", F.lit(True))
    return refs.join(known, "reference_id", "left").select("group_id", "reference_id", F.col("hit").isNotNull().alias("resolved"))


_FEATURES = """
with a as (select *, abs(amount_minor) as a from recon_record)
select run_id, count(*)::double as record_count, count(distinct source)::double as source_count, count(distinct kind)::double as kind_count,
  round(avg(coalesce(kind = 'payment', false)::int::double), 6) as payment_frac, round(avg(coalesce(kind = 'credit', false)::int::double), 6) as credit_frac,
  round(avg((coalesce(reference, '') <> '')::int::double), 6) as has_reference_frac, round(avg((coalesce(counterparty, '') <> '')::int::double), 6) as has_counterparty_frac,
  round(avg((value_date is not null)::int::double), 6) as has_value_date_frac, round(count(distinct nullif(counterparty, '')) / count(*)::double, 6) as counterparty_cardinality,
  round(log10(greatest(coalesce(list_sort(list(a) filter (where a is not null))[count(a) // 2 + 1], 1), 1) + 1), 6) as amount_log_median,
  round(case when count(*) > 1 then stddev_pop(a) / (avg(a) + 1) else 0.0 end, 6) as amount_cv from a group by run_id
"""


@query(_FEATURES)
def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    return L.feature_profile(table(spark, d, "recon_record"), "run_id")


@query(f"""
with prof as (select f.*, r.org_id, r.started_at from ({_FEATURES}) f join recon_run r using (run_id)),
long as (select org_id, run_id, started_at, feature, value from prof unpivot (value for feature in ({', '.join(L.FEATURES)}))),
base as (select *, avg(value) over w as baseline, count(value) over w as runs_before from long window w as (partition by org_id, feature order by started_at, run_id rows between unbounded preceding and 1 preceding)),
s as (select *, greatest(baseline, 1e-6) as b, greatest(value, 1e-6) as c from base)
select run_id, feature, runs_before, case when baseline is not null then round((c / (b + c) - b / (b + c)) * ln((c / (b + c)) / (b / (b + c))), 5) end as psi from s""")
def psi_drift(spark: SparkSession, d: str) -> DataFrame:
    prof = L.feature_profile(table(spark, d, "recon_record"), "run_id").join(table(spark, d, "recon_run").select("run_id", "org_id", "started_at"), "run_id")
    long = prof.select("org_id", "run_id", "started_at", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in L.FEATURES))).alias("x")).select("org_id", "run_id", "started_at", "x.*")
    w = Window.partitionBy("org_id", "feature").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    x = long.withColumn("baseline", F.avg("value").over(w)).withColumn("runs_before", F.count("value").over(w))
    return x.select("run_id", "feature", "runs_before", F.when(F.col("baseline").isNotNull(), F.round(L.psi(F.col("baseline"), F.col("value")), 5)).alias("psi"))


_CONF = "select least(abs(residual_minor) / 10000.0, 1.0)::double as confidence, ledger_crosscheck_ok as correct from decomposition where residual_minor is not null and ledger_crosscheck_ok is not null"


def _conf(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "decomposition").where("residual_minor is not null and ledger_crosscheck_ok is not null")
    return x.select(F.least(F.abs("residual_minor") / 10000.0, F.lit(1.0)).cast("double").alias("confidence"), F.col("ledger_crosscheck_ok").alias("correct"))


@query(f"select cast(least(floor(confidence * 10), 9) as integer) as bucket, count(*) as n, round(avg(confidence), 6) as mean_confidence, round(avg(correct::int::double), 6) as accuracy from ({_CONF}) group by bucket")
def ece_buckets(spark: SparkSession, d: str) -> DataFrame:
    return L.calibration_buckets(_conf(spark, d), "confidence", "correct")


@query(f"""
with per as (select confidence, count(*) filter (where correct) as pos, count(*) filter (where not correct) as neg from ({_CONF}) group by confidence),
x as (select *, pos * (coalesce(sum(neg) over (order by confidence rows between unbounded preceding and 1 preceding), 0) + neg / 2.0) as wins from per)
select round(sum(wins)::double / (sum(pos) * sum(neg)), 6) as auc, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from x""")
def auc_mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return L.auc(_conf(spark, d), "confidence", "correct")


@query(f"""
with r as ({_CONF}), cuts as (select distinct round(confidence, 3) as cut from r),
s as (select cut, (select count(*) from r where (confidence >= cut and correct) or (confidence < cut and not correct)) as right_ from cuts)
select round(greatest(0.45, least(0.9, arg_max(cut, struct_pack(r := right_, c := -cut)))), 3) as threshold, max(right_) as "right" from s""")
def threshold_tune(spark: SparkSession, d: str) -> DataFrame:
    return L.best_threshold(_conf(spark, d), "confidence", "correct")


@query("""
select doc_id, category, votes from (select doc_id, category, count(*) as votes, min(annotator) as f from abuse_label group by all)
qualify row_number() over (partition by doc_id order by votes desc, f, category) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return L.majority(table(spark, d, "abuse_label"), "doc_id", "category", "annotator")


@query("""
select vec_id as query, v.vec_id_2 as vec_id, similarity, rank from (
  select q.vec_id, v.vec_id as vec_id_2, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id) as rank
  from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0) v where rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return Y.dense_topk(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


def _bags(spark: SparkSession, d: str, by_doc: bool = False) -> DataFrame:
    """Counted tokens per document; ``by_doc`` shuffles the texts, so that a document's tokens lie together."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    x = (x.repartition("doc") if by_doc else x).select("doc", F.explode(R.tokens("text")).alias("token"))
    return x.groupBy("doc", "token").agg(F.count(F.lit(1)).cast("double").alias("w"))


@query("""
with t as (select doc_id as doc, unnest(list_filter(string_split_regex(upper(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) as token from documents),
bag as (select doc, token, count(*)::double as w from t group by all),
idf as (select token, ln(((select count(distinct doc) from bag) + 1.0) / (count(*) + 1.0)) + 1 as idf from bag group by token),
v as (select doc, token, w * idf as x from bag join idf using (token)),
u as (select v.doc, token, x / norm as x from v join (select doc, sqrt(sum(x * x)) as norm from v group by doc) using (doc)),
s as (select q.doc as query, d.doc as doc, round(sum(q.x * d.x), 6) as similarity from u q join u d using (token) where q.doc % 50 = 0 and q.doc <> d.doc group by all)
select query, doc, similarity, rank from (select *, row_number() over (partition by query order by similarity desc, doc) as rank from s where similarity >= 0.15) where rank <= 3""")
def idf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Most similar documents by IDF-cosine for every document whose id is divisible by 50, against all documents."""
    bags = _bags(spark, d, by_doc=True)
    return Y.cosine_recall(bags, bags.where("doc % 50 = 0")).withColumn("rank", F.col("rank").cast("bigint"))


@query("""
with t as (select distinct doc_id, unnest(list_filter(string_split_regex(upper(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) as token from documents)
select token, count(*) as df, round(ln(((select count(distinct doc_id) from t) + 1.0) / (count(*) + 1.0)) + 1, 6) as idf from t group by token""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return Y.idf(_bags(spark, d), "doc", "token").select("token", "df", F.round("idf", 6).alias("idf"))


@query()
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return Y.hashed_vector(_bags(spark, d), "doc", "token", "w")


def _edges(v: str, edges: list[int]) -> str:
    return "case " + " ".join(f"when abs({v}) <= {e} then '<={e}'" for e in edges) + f" else '>{edges[-1]}' end"


@query(f"""
with r as (select run_id, external_ids['settlement_utr'] as utr, list_sort(list(distinct source)) as sources, list_sort(list(distinct kind)) as kinds, count(*) as n from recon_record where external_ids['settlement_utr'] is not null group by all)
select d.group_id, d.run_id, substr(sha256('UNEXPLAINED|' || {_edges('residual_minor', RESIDUAL_EDGES)} || '|' || {_edges('n', COUNT_EDGES)} || '|' || array_to_string(sources, ',') || '|' || array_to_string(kinds, ',')), 1, 24) as shape_key
from decomposition d join r on r.run_id = d.run_id and r.utr = d.settlement_utr""")
def shape_key(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recon_record").groupBy("run_id", F.element_at("external_ids", "settlement_utr").alias("settlement_utr")).agg(F.collect_set("source").alias("sources"), F.collect_set("kind").alias("kinds"), F.count(F.lit(1)).alias("n")).where("settlement_utr is not null")
    x = table(spark, d, "decomposition").join(r, ["run_id", "settlement_utr"])
    key = Y.shape_key(F.lit(None).cast("string"), F.col("residual_minor"), F.col("n"), F.col("sources"), F.col("kinds"))
    return x.select("group_id", "run_id", key.alias("shape_key"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").cast("string").alias("payload"))


_CHAIN = """
with e as (select user_id, list(struct_pack(ts := ts, id := event_id, k := event_type, p := cast(event_id as varchar)) order by ts, event_id) as e from events group by user_id)
select user_id, len(e) as events, list_reduce(list_prepend('', list_transform(e, lambda x: x.k || '|' || x.p)), lambda a, x: sha256(a || '|' || x)) as terminal from e
"""


@query(_CHAIN)
def hash_chain_terminal(spark: SparkSession, d: str) -> DataFrame:
    c = E.chain(_events(spark, d), "user_id", ["ts", "event_id"], "event_type", "payload")
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max(F.struct("seq", "hash")).alias("x")).select("user_id", "events", F.col("x.hash").alias("terminal"))


@query("""
with e as (select user_id, list(struct_pack(ts := ts, id := event_id, k := event_type, p := cast(event_id as varchar)) order by ts, event_id) as e from events group by user_id),
h as (select user_id, e, list_reduce(list_prepend([''], list_transform(e, lambda x: [x.k || '|' || x.p])), lambda a, x: list_append(a, sha256(a[-1] || '|' || x[1]))) as h from e),
v as (select user_id, len(e) as events, list_filter(range(1, len(e) + 1), lambda i: sha256(h[i] || '|' || e[i].k || '|' || e[i].p || case when user_id % 10 = 0 and i = 3 then 'x' else '' end) <> h[i + 1]) as bad from h)
select user_id, events, len(bad) = 0 as ok, bad[1] as first_break from v""")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth run's third event is tampered with; verification finds the first break."""
    c = E.chain(_events(spark, d), "user_id", ["ts", "event_id"], "event_type", "payload")
    bad = c.withColumn("payload", F.when((F.col("user_id") % 10 == 0) & (F.col("seq") == 3), F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return E.verify(bad, "user_id").withColumn("first_break", F.col("first_break").cast("bigint"))


@query("select user_id, count(*) as events, arg_max(event_type, struct_pack(t := ts, i := event_id)) as event_type, arg_max(value, struct_pack(t := ts, i := event_id)) as value from events group by user_id")
def fold_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("select source, count(*) as rows, count(distinct id) as ids from recon_record group by source")
def counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return E.counts_by(table(spark, d, "recon_record"), "source")


@query("""
select g.group_id, g.clean, d.residual_minor, d.residual_minor is not null and abs(d.residual_minor) <= 100 as tied
from (select distinct group_id, run_id, settlement_utr, clean from gt_match) g left join (select run_id, settlement_utr, min(residual_minor) as residual_minor from decomposition where settlement_utr is not null group by all) d using (run_id, settlement_utr)""")
def scorecard_rows(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gt_match").select("group_id", "run_id", "settlement_utr", "clean").distinct()
    dec = table(spark, d, "decomposition").where("settlement_utr is not null").groupBy("run_id", "settlement_utr").agg(F.min("residual_minor").alias("residual_minor"))
    return g.join(dec, ["run_id", "settlement_utr"], "left").select("group_id", "clean", "residual_minor", (F.col("residual_minor").isNotNull() & (F.abs("residual_minor") <= 100)).alias("tied"))


@query("""
with s as (select g.clean, g.expected_net_minor as net, d.residual_minor is not null and abs(d.residual_minor) <= 100 as tied
  from (select distinct group_id, run_id, settlement_utr, clean, expected_net_minor from gt_match) g left join (select run_id, settlement_utr, min(residual_minor) as residual_minor from decomposition where settlement_utr is not null group by all) d using (run_id, settlement_utr))
select count(*) as batches, round(count(*) filter (where tied and clean)::double / nullif(count(*) filter (where clean), 0), 4) as recall, round(count(*) filter (where tied and clean)::double / nullif(count(*) filter (where tied), 0), 4) as "precision",
  round(sum(case when tied then abs(net) else 0 end)::double / sum(abs(net)), 4) as money_coverage from s""")
def scorecard_matching(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gt_match").select("group_id", "run_id", "settlement_utr", "clean", "expected_net_minor").distinct()
    dec = table(spark, d, "decomposition").where("settlement_utr is not null").groupBy("run_id", "settlement_utr").agg(F.min("residual_minor").alias("residual_minor"))
    x = g.join(dec, ["run_id", "settlement_utr"], "left").withColumn("tied", F.coalesce(F.abs("residual_minor") <= 100, F.lit(False)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = n(F.col("tied") & F.col("clean"))
    return x.agg(
        F.count(F.lit(1)).alias("batches"),
        F.round(F.try_divide(both, n(F.col("clean"))), 4).alias("recall"),
        F.round(F.try_divide(both, n(F.col("tied"))), 4).alias("precision"),
        F.round(F.sum(F.when(F.col("tied"), F.abs("expected_net_minor")).otherwise(0)) / F.sum(F.abs("expected_net_minor")), 4).alias("money_coverage"),
    )
