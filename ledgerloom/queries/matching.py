"""Settlement identity and the matching cascade over order-line batches and bank credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount_level
from ..operators import cascade as C
from ..operators import fs
from ..operators import matching as M
from ..operators import views as V
from ..tables import table, written

QUERIES = {}
SQL = {}
#: Calibration points of the interpolation query.
POINTS = [(0.1, 0.05), (0.4, 0.35), (0.7, 0.8), (0.95, 0.97)]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lines = V.proc(spark, d)
    # Credits, outcomes and later passes all start from the batches, so the lines are aggregated once.
    batches = written(V.batch(lines), "batches")
    return lines, batches, V.bank(spark, d, batches), V.ledger(lines)


_OUTCOME = f"""{V.VIEWS_SQL},
tied as (
  select batch_key, arg_min(struct_pack(credit_id := credit_id, amount := amount, value_date := value_date), struct_pack(g := abs(amount - net), c := credit_id)) as t
  from batch join bank on bank.utr = batch_key group by batch_key),
outcome as (
  select batch.*, t.credit_id, t.amount, t.value_date, ledger_total, t.amount - net as residual, coalesce(gross = nullif(ledger_total, 0), true) as ledger_ok
  from batch left join tied using (batch_key) left join ledger using (batch_key)),
named as (
  select *, case when credit_id is null then 'no_credit' when residual = 0 and ledger_ok then 'exact' when abs(residual) <= 200 then 'tolerant' else 'out_of_tolerance' end as outcome from outcome)
"""


@query(f"with {V.VIEWS_SQL} select batch_key, n, net, gross, refunds, mdr, gst, dup from batch")
def settlement_identity(spark: SparkSession, d: str) -> DataFrame:
    return _views(spark, d)[1].select("batch_key", "n", "net", "gross", "refunds", "mdr", "gst", "dup")


@query(f"with {_OUTCOME} select batch_key, credit_id, residual, ledger_ok, outcome from named")
def utr_match_outcome(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    return M.outcome(b, c, led).select("batch_key", "credit_id", "residual", "ledger_ok", "outcome")


@query(f"with {_OUTCOME} select batch_key, credit_id, net from named where outcome = 'exact'")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    return M.outcome(b, c, led).where("outcome = 'exact'").select("batch_key", "credit_id", "net")


_W = {f: " ".join(f"when '{k}' then {fs.bits(*mu)!r}" for k, mu in v.items()) for f, v in fs.PRIOR.items()}
_AL = "case when abs(amount - net) = 0 then 'exact' when abs(amount - net) <= 100 then 'within_rounding' when abs(amount - net) <= 200 then 'within_tol' when abs(amount - net) <= greatest(abs(amount), abs(net)) * 0.01 then 'within_1pct' else 'none' end"
_DL = "case when abs(value_date - settled_at) = 0 then 'same_day' when abs(value_date - settled_at) <= 1 then 'within_1' when abs(value_date - settled_at) <= 4 then 'within_window' else 'none' end"
_FIX = fs.bits(*fs.PRIOR["reference"]["exact"]) + fs.bits(*fs.PRIOR["idlink"]["shared"])
_FREE = fs.bits(*fs.PRIOR["reference"]["none"]) + fs.bits(*fs.PRIOR["idlink"]["none"])
#: The prior is one over the number of batches.
_PRIOR = "(select 1.0::double / greatest(count(*), 1) from batch)"


@query(f"""with {_OUTCOME},
w as (select *, {_AL} as amount_level, {_DL} as date_level from named where outcome = 'tolerant'),
b as (select *, case amount_level {_W['amount']} end + case date_level {_W['date']} end + {_FIX!r} as bits from w),
p as (select b.*, (q / (1 - q)) * pow(2.0, bits) as odds from b, (select least(1 - 1e-9, greatest(1e-9, {_PRIOR})) as q))
select batch_key, amount_level, date_level, round(bits, 3) as weight_bits, round(case when ledger_ok then odds / (1 + odds) else least(odds / (1 + odds), 0.7) end, 6) as confidence from p""")
def tolerant_match(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    tied = M.outcome(b, c, led).where("outcome = 'tolerant'")
    return M.tolerant_confidence(tied, 1.0 / max(1, b.count())).select("batch_key", "amount_level", "date_level", "weight_bits", "confidence")


@query(f"""
select group_id, run_id, round(case when p <= 0.1 then 0.05 when p >= 0.95 then 0.97 when p <= 0.4 then 0.05 + 0.3 * (p - 0.1) / 0.3 when p <= 0.7 then 0.35 + 0.45 * (p - 0.4) / 0.3 else 0.8 + 0.17 * (p - 0.7) / 0.25 end, 6) as calibrated
from (select group_id, run_id, (abs(expected_minor) % 1000) / 1000.0::double as p from decomposition)""")
def calibrate_interpolate(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "decomposition").select("group_id", "run_id", ((F.abs("expected_minor") % 1000) / 1000.0).alias("p"))
    return x.select("group_id", "run_id", F.round(fs.calibrated(F.col("p"), POINTS), 6).alias("calibrated"))


@query(f"""
with x as (select settlement_utr is not null as is_match, {_AL.replace('amount', 'actual_minor').replace('net', 'expected_minor')} as level from decomposition),
grid as (select unnest(['exact', 'within_rounding', 'within_tol', 'within_1pct', 'none']) as level),
per as (select level, count(*) filter (where is_match) as pos, count(*) filter (where not is_match) as neg from x group by level)
select 'amount' as field, level, round((coalesce(pos, 0) + 1.0) / (sum(coalesce(pos, 0)) over () + 5.0), 9) as m, round((coalesce(neg, 0) + 1.0) / (sum(coalesce(neg, 0)) over () + 5.0), 9) as u
from grid left join per using (level)""")
def mu_estimation(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "decomposition").select(F.col("settlement_utr").isNotNull().alias("is_match"), amount_level("actual_minor", "expected_minor").alias("amount"))
    return fs.estimate(x, {"amount": list(fs.PRIOR["amount"])})


_BAND = f"""{_OUTCOME},
free_batch as (select * from named where credit_id is null),
free_bank as (select * from bank where utr is null or utr not in (select batch_key from batch)),
band as (select b.batch_key, c.credit_id, abs(c.amount - b.net) as gap, abs(c.value_date - b.settled_at) as days, c.amount - b.net as residual, b.ledger_ok
  from free_batch b join free_bank c on c.amount between b.net - 200 and b.net + 200 where abs(c.value_date - b.settled_at) <= 4 or abs(c.amount - b.net) <= 100)
"""


def _band(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    free = M.outcome(b, c, led).where("outcome = 'no_credit'").select("batch_key", "net", "settled_at", "ledger_ok")
    orphan = c.join(b.select(F.col("batch_key").alias("utr")), "utr", "left_anti")
    return M.amount_band_pairs(free, orphan)


@query(f"with {_BAND} select batch_key, credit_id, gap, days from band")
def amount_band_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _band(spark, d).select("batch_key", "credit_id", "gap", F.col("days").cast("bigint").alias("days"))


_PAIRS = f"""{_BAND},
ranked as (select *, row_number() over w as rk, lead(gap) over w as next_gap from band window w as (partition by batch_key order by gap, credit_id)),
unclear as (select batch_key from ranked where rk = 1 and next_gap - gap <= 100),
pair as (select batch_key, credit_id, gap, residual, case when days = 0 then 0 when days <= 1 then 1 when days <= 4 then 2 else 3 end as level,
  round(least(c, case when batch_key in (select batch_key from unclear) then 0.69 else 1 end, case when ledger_ok then 1 else 0.7 end), 4) as confidence from (
  select *, case when days = 0 then 0.94 when days <= 1 then 0.90 when days <= 4 then 0.85 else 0.80 end::double - case when gap > 100 then 0.1 else 0.0 end::double as c from ranked))
"""
#: Sequential greedy: one pair after the other in its order, each kept if both its ends are still free.
_BLOCKED = f"""{_PAIRS},
blocked as (select unnest(acc.rows, recursive := true) from (
  select list_reduce(list(struct_pack(bs := [batch_key], cs := [credit_id], rows := [struct_pack(batch_key := batch_key, credit_id := credit_id, gap := gap, level := level, residual := residual, confidence := confidence)]) order by gap, level, credit_id, cast(batch_key as varchar)),
    lambda a, x: case when list_contains(a.bs, x.bs[1]) or list_contains(a.cs, x.cs[1]) then a else struct_pack(bs := list_concat(a.bs, x.bs), cs := list_concat(a.cs, x.cs), rows := list_concat(a.rows, x.rows)) end) as acc
  from pair where confidence >= 0.7))
"""
#: What the pool passes took, as three lists of ids; none where a query stops before them.
POOLS_SQL = "pool_batch(batch_key, tied) as (select 0, 0 where false), pool_credit(credit_id) as (select '' where false), pool_payment(payment_id) as (select '' where false)"
_CASCADE = f"""{_BLOCKED}, {{pools}},
in_part as (select distinct batch_key from proc where payment_id in (select payment_id from pool_payment)),
closed as (
  select n.*, case when n.outcome in ('exact', 'tolerant') then n.outcome when b.batch_key is not null then 'blocked' when p.batch_key is not null then 'aggregate' when i.batch_key is not null then 'subset' end as match_pass,
    case when n.outcome in ('exact', 'tolerant') then n.residual when b.batch_key is not null then b.residual when p.batch_key is not null then p.tied end as tied
  from named n left join blocked b using (batch_key) left join pool_batch p using (batch_key) left join in_part i using (batch_key)),
open_credit as (select * from free_bank where credit_id not in (select credit_id from blocked) and credit_id not in (select credit_id from pool_credit))
"""
BLOCKED_ONLY = _CASCADE.replace("{pools}", POOLS_SQL)


def cascade(spark: SparkSession, d: str, pools: bool = True) -> C.Cascade:
    lines, b, c, led = _views(spark, d)
    return C.run(b, c, lines, led, pools)


@query(f"with {_PAIRS} select batch_key, credit_id, gap, confidence from pair")
def blocked_pair_confidence(spark: SparkSession, d: str) -> DataFrame:
    return M.blocked_confidence(_band(spark, d)).select("batch_key", "credit_id", "gap", "confidence")


@query(f"with {_BLOCKED} select batch_key, credit_id, gap, level, confidence from blocked")
def blocked_greedy(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one assignment of the confident band pairs, closest gap first, then date level, then ids."""
    pairs = M.blocked_confidence(_band(spark, d)).where(F.col("confidence") >= M.REVIEW)
    return M.greedy(pairs, ["gap", "level"], "batch_key", "credit_id", ["confidence"])


_MATCHES = f"""with {BLOCKED_ONLY},
w as (select *, {_AL} as amount_level, {_DL} as date_level from named where outcome = 'tolerant'),
b as (select *, case amount_level {_W['amount']} end + case date_level {_W['date']} end + {_FIX!r} as bits from w),
p as (select b.*, (q / (1 - q)) * pow(2.0, bits) as odds from b, (select least(1 - 1e-9, greatest(1e-9, {_PRIOR})) as q)),
all_ as (
  select 'm_' || batch_key as match_id, 'exact' as match_pass, credit_id, residual, 1.0::double as confidence, null::double as weight_bits from named where outcome = 'exact'
  union all select 'm_' || batch_key, 'tolerant', credit_id, residual, round(case when ledger_ok then odds / (1 + odds) else least(odds / (1 + odds), 0.7) end, 4), round(bits, 3) from p
  union all select 'm_' || batch_key, 'blocked', credit_id, residual, confidence, null from blocked)
select *, case when confidence >= 0.9 then 'auto' else 'low_confidence' end as status from all_"""


def _matches(c: C.Cascade) -> DataFrame:
    return c.matches.select("match_id", "match_pass", F.col("credits")[0].alias("credit_id"), "residual", "confidence", "weight_bits", "status")


@query(_MATCHES)
def matches_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the exact, tolerant and blocked passes, with status."""
    return _matches(cascade(spark, d, pools=False))


@query()
def cascade_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches of all passes, with the ids of each side and status (the pool passes are tested against a plain loop)."""
    return cascade(spark, d).matches


@query()
def pool_passes(spark: SparkSession, d: str) -> DataFrame:
    """Aggregate, split and subset matches over what the exact, tolerant and blocked passes left.

    The passes know no dates, and the tables are one tenant's, so the whole run is one partition.
    """
    x = cascade(spark, d).matches.where("match_pass in ('aggregate', 'subset')")
    kind = F.when(F.col("match_pass") == "subset", "subset").when(F.size("batches") > 1, "aggregate").otherwise("split")
    return x.select(kind.alias("pass"), "credits", F.when(kind == "subset", F.col("payments")).otherwise(F.col("batches")).alias("members"), "residual", "confidence", "status")


FUZZY_SQL = f"""with {_CASCADE},
own as (select b.batch_key, b.net, b.settled_at, p.party from closed b left join party p using (batch_key) where match_pass is null),
ask as (select c.credit_id, c.amount, c.value_date, p.party as c_party from open_credit c left join party p on p.batch_key = cast(substr(c.credit_id, 4) as bigint)),
s as (select credit_id, batch_key, round(case {_AL} {_W['amount']} end + case {_DL} {_W['date']} end + {_FREE!r} + case when c_party = party then 1 else 0 end, 3) as score_bits from ask, own)
select * from (select *, row_number() over (partition by credit_id order by score_bits desc, cast(batch_key as varchar)) as rank from s) where rank <= 3"""


def _fuzzy(spark: SparkSession, d: str, pools: bool) -> DataFrame:
    done, party = cascade(spark, d, pools), V.party(spark, d)
    own = done.open_batches().join(party, "batch_key", "left")
    key = F.substring("credit_id", 4, 20).cast("bigint")
    ask = done.open_credits().withColumn("batch_key", key).join(party, "batch_key", "left").drop("batch_key")
    return M.fuzzy_top(own, ask).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def fuzzy_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three best open batches for each credit that the whole cascade left."""
    return _fuzzy(spark, d, True)


@query(FUZZY_SQL.replace("{pools}", POOLS_SQL))
def fuzzy_top3_before_pools(spark: SparkSession, d: str) -> DataFrame:
    """The same for what the blocked pass left, which SQL can say."""
    return _fuzzy(spark, d, False)


@query(f"with {_OUTCOME} select outcome, count(*) as batches, cast(sum(net) as bigint) as net, cast(sum(coalesce(residual, 0)) as bigint) as residual, count(*) filter (where not ledger_ok) as ledger_breaks from named group by outcome")
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    _, b, c, led = _views(spark, d)
    x = M.outcome(b, c, led)
    return x.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("net").alias("net"),
        F.sum(F.coalesce("residual", F.lit(0))).alias("residual"),
        F.sum((~F.col("ledger_ok")).cast("bigint")).alias("ledger_breaks"),
    )


@query("""
with r as (select org_id, upper(trim(external_ids['settlement_utr'])) as utr, min(struct_pack(k := kind, a := amount_minor, f := fee_minor, t := tax_minor)) as x
  from recon_record where source = 'processor_recon' and kind <> 'transfer' group by org_id, utr, id)
select org_id, utr, count(*) as records, cast(sum(x.a - x.f - x.t) as bigint) as expected_minor,
  cast(sum(case when x.k = 'payment' then x.a else 0 end) as bigint) as gross, cast(sum(case when x.k = 'refund' then x.a else 0 end) as bigint) as refunds,
  cast(sum(case when x.k in ('adjustment', 'chargeback') and x.a < 0 then x.a else 0 end) as bigint) as adjustment_debits,
  cast(sum(case when x.k in ('adjustment', 'chargeback') and x.a > 0 then x.a else 0 end) as bigint) as adjustment_credits,
  cast(sum(x.f) as bigint) as mdr, cast(sum(x.t) as bigint) as gst_on_mdr
from r where utr <> '' group by org_id, utr""")
def decomposition_components(spark: SparkSession, d: str) -> DataFrame:
    """Components per settlement reference over the canonical records; each id counts once."""
    r = table(spark, d, "recon_record").where("source = 'processor_recon' and kind <> 'transfer'")
    utr = F.nullif(F.upper(F.trim(F.element_at("external_ids", "settlement_utr"))), F.lit(""))
    row = F.min(F.struct(F.col("kind").alias("k"), F.col("amount_minor").alias("a"), F.col("fee_minor").alias("f"), F.col("tax_minor").alias("t")))
    x = r.groupBy("org_id", utr.alias("utr"), "id").agg(row.alias("x")).where("utr is not null").select("org_id", "utr", "x.*")
    some = lambda c: F.sum(F.when(c, F.col("a")).otherwise(0)).cast("bigint")
    adj = F.col("k").isin("adjustment", "chargeback")
    return x.groupBy("org_id", "utr").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.col("a") - F.col("f") - F.col("t")).alias("expected_minor"),
        some(F.col("k") == "payment").alias("gross"),
        some(F.col("k") == "refund").alias("refunds"),
        some(adj & (F.col("a") < 0)).alias("adjustment_debits"),
        some(adj & (F.col("a") > 0)).alias("adjustment_credits"),
        F.sum("f").alias("mdr"),
        F.sum("t").alias("gst_on_mdr"),
    )


@query("""
with r as (select distinct id, upper(trim(reference)) as x, upper(trim(external_ids['settlement_utr'])) as y from recon_record where external_ids['settlement_utr'] is not null),
s as (select *, jaro_similarity(x, y) as j, case when left(x, 1) <> left(y, 1) then 0 when left(x, 2) <> left(y, 2) then 1 when left(x, 3) <> left(y, 3) then 2 when left(x, 4) <> left(y, 4) then 3 else least(4, length(x), length(y)) end as p from r)
select id, case when x = y then 'exact' when x is null or y is null then 'none' when j + p * 0.1 * (1 - j) >= 0.9 then 'jaro_hi' when j + p * 0.1 * (1 - j) >= 0.7 then 'jaro_mid' else 'none' end as level from s""")
def reference_levels(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler levels between a record's reference and its settlement reference (tested by brute force)."""
    r = table(spark, d, "recon_record").select("id", "reference", F.element_at("external_ids", "settlement_utr").alias("utr")).where("utr is not null").dropDuplicates(["id"])
    return r.select("id", M.reference_level("reference", "utr").alias("level"))
