"""Typed exceptions of a reconciliation: producers with one schema, a residual ladder, register, clusters, cash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import direction, impact_band
from ..functions.refs import injection_index
from .matching import ROUNDING, TOLERANCE
from .rules import Rule, first_match

COLUMNS = ["exception_id", "producer", "subject", "batch_key", "category", "classified_by", "impact", "confidence"]


def exception_id(producer: Column, subject: Column) -> Column:
    return F.concat(F.lit("exc_"), F.substring(F.sha2(F.concat_ws("|", producer, subject.cast("string")), 256), 1, 12))


def _made(df: DataFrame, producer: str, subject: str, category: Column | str, by: Column | str, impact: Column, confidence: Column | float | None) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        exception_id(F.lit(producer), F.col(subject)).alias("exception_id"),
        F.lit(producer).alias("producer"),
        F.col(subject).cast("string").alias("subject"),
        (F.col("batch_key") if "batch_key" in df.columns else F.lit(None)).cast("bigint").alias("batch_key"),
        col(category).cast("string").alias("category"),
        col(by).cast("string").alias("classified_by"),
        impact.cast("bigint").alias("impact"),
        col(confidence).cast("double").alias("confidence"),
    )


def ladder(residual: Column, fees: Column, ledger_ok: Column, has_fx: Column, expected: Column) -> tuple[Column, Column, Column]:
    """(category, rule, confidence) of a residual: rounding, spread of a conversion, ledger gap, share of the fees."""
    gap = F.abs(residual)
    steps = [
        (gap <= ROUNDING, "ROUNDING", "rule:rounding", 0.95),
        (has_fx & (gap <= F.abs(expected) * 0.02), "FX_DIFFERENCE", "rule:fx_spread", 0.75),
        (~ledger_ok, "PARTIAL_PAYMENT", "unclassified", 0.6),
        (gap <= F.greatest(fees, F.lit(1)) * 0.25, "FEE_DEDUCTION", "rule:fee_drift", 0.7),
    ]
    category, rule, conf = F.lit("UNEXPLAINED"), F.lit("unclassified"), F.lit(None).cast("double")
    for test, c, r, p in reversed(steps):
        category, rule, conf = F.when(test, c).otherwise(category), F.when(test, r).otherwise(rule), F.when(test, p).otherwise(conf)
    return category, rule, conf


def security(lines: DataFrame) -> DataFrame:
    """Lines whose free text tries to give instructions; they come before everything else."""
    x = lines.where(injection_index("memo").isNotNull()).groupBy("payment_id").agg(F.max(F.abs("amount")).alias("amount"), F.min("batch_key").alias("batch_key"))
    return _made(x, "security", "payment_id", "SECURITY_REVIEW", "rule:r_security_scan", F.col("amount"), 1.0)


def _residual(x: DataFrame, residual: str, rules: list[Rule]) -> DataFrame:
    """Classified by the first of ``rules`` that holds, else by the ladder."""
    x = x.withColumns({"residual_minor": F.col(residual), "expected_minor": F.col("net"), "fees_minor": F.col("mdr") + F.col("gst"), "ledger_crosscheck_ok": F.col("ledger_ok")})
    ruled, rule_id = first_match(rules, set(x.columns))
    category, rule, conf = ladder(F.col(residual), F.col("fees_minor"), F.col("ledger_ok"), F.col("has_fx"), F.col("net"))
    by = F.when(ruled.isNotNull(), F.concat(F.lit("rule:"), rule_id)).otherwise(rule)
    conf = F.when(ruled.isNotNull(), F.when(ruled != "UNEXPLAINED", 0.9)).otherwise(conf)
    return _made(x, "residual", "batch_key", F.coalesce(ruled, category), by, F.col(residual), conf)


def residuals(batches: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """Matched batches off by more than rounding; open batches (without a repeated payment) whose credit is too far off."""
    tied = batches.where("match_pass is not null").where(F.abs("tied") > ROUNDING)
    far = batches.where("match_pass is null and not dup and credit_id is not null")
    return _residual(tied, "tied", list(rules)).unionByName(_residual(far, "residual", list(rules)))


def ledger_breaks(batches: DataFrame) -> DataFrame:
    """Matched batches that tie but whose ledger total does not agree."""
    x = batches.where(f"match_pass is not null and not ledger_ok and abs(tied) <= {ROUNDING}")
    return _made(x, "ledger", "batch_key", "PARTIAL_PAYMENT", "unclassified", F.when(F.col("tied") != 0, F.col("tied")).otherwise(-1), None)


def chargebacks(batches: DataFrame) -> DataFrame:
    """Matched batches with disputed lines."""
    return _made(batches.where("match_pass is not null and disputed > 0"), "chargeback", "batch_key", "CHARGEBACK", "rule:r_chargeback", F.col("disputed"), 0.85)


def duplicates(batches: DataFrame) -> DataFrame:
    """Open batches in which a payment id repeats; nothing else is said of them."""
    return _made(batches.where("match_pass is null and dup"), "duplicate", "batch_key", "DUPLICATE", "rule:repeated_payment", F.abs("net"), 0.9)


def missing_credits(batches: DataFrame, period_end: str) -> DataFrame:
    """Open batches without a credit: timing when settled after the period or in its first three days, else wrong account."""
    late = (F.col("settled_at") > F.lit(period_end).cast("date")) | (F.dayofmonth("settled_at") <= 3)
    return _made(batches.where("match_pass is null and not dup and credit_id is null"), "missing", "batch_key", F.when(late, "TIMING").otherwise("WRONG_ACCOUNT"), "rule:no_credit", F.abs("net"), 0.7)


def orphan_credits(credits: DataFrame, batches: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Unmatched credits without a batch of theirs: missing reference where one ties an open net within rounding, timing
    where one settles a batch that an earlier run left open, else unexplained.

    The existence tests are equi-joins on amount buckets of one rounding unit.
    """
    around = lambda v: F.explode(F.sequence(F.floor(v / ROUNDING) - 1, F.floor(v / ROUNDING) + 1))
    free = batches.where("match_pass is null").select("net", around(F.col("net")).alias("slot"))
    own = credits.where("match_pass is null and not keyed").select("credit_id", "utr", "amount").withColumn("slot", F.floor(F.col("amount") / ROUNDING))
    ties = own.join(free, own["slot"] == free["slot"]).where(F.abs(F.col("amount") - F.col("net")) <= ROUNDING).select("credit_id").distinct().withColumn("ties", F.lit(True))
    x = own.drop("slot").join(ties, "credit_id", "left")
    if prior is not None:
        held = carry_forward(own.select("credit_id", F.col("utr").cast("string").alias("utr"), "amount"), prior, ROUNDING).select("credit_id", F.lit(True).alias("carried"))
        x = x.join(held, "credit_id", "left")
    else:
        x = x.withColumn("carried", F.lit(None).cast("boolean"))
    pick = lambda a, b, c: F.when(F.col("ties"), a).when(F.col("carried"), b).otherwise(c)
    return _made(x, "orphan", "credit_id", pick("MISSING_UTR", "TIMING", "UNEXPLAINED"), pick("rule:amount_ties", "rule:r_cross_period", "unclassified"), F.abs("amount"), pick(0.7, 0.75, None))


def unmapped_orders(payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Payments (payment_id, order_id, amount, perhaps batch_key) whose order the ledger does not have; one per id."""
    keep = [F.min("batch_key").alias("batch_key")] if "batch_key" in payments.columns else []
    x = payments.join(ledger.select("order_id").distinct(), "order_id", "left_anti").groupBy("payment_id").agg(F.max(F.abs("amount")).alias("amount"), *keep)
    return _made(x, "unmapped", "payment_id", "UNEXPLAINED", "unclassified", F.col("amount"), None)


def linked_credits(exceptions: DataFrame, credits: DataFrame) -> DataFrame:
    """(exception_id, credit_id): the credits that came in under the reference of an exception's batch."""
    return exceptions.where("batch_key is not null").select("exception_id", F.col("batch_key").alias("utr")).join(credits.where("utr is not null").select("utr", "credit_id"), "utr").select("exception_id", "credit_id")


def register(parts: list[DataFrame]) -> DataFrame:
    """All producers' exceptions; of one id the first producer's in the given order, then by impact."""
    all_ = None
    for k, p in enumerate(parts):
        p = p.select(*COLUMNS).withColumn("_at", F.lit(k))
        all_ = p if all_ is None else all_.unionByName(p)
    first = all_.groupBy("exception_id").agg(F.min(F.struct("_at", F.abs("impact").alias("_i"), *COLUMNS[1:])).alias("x"))
    return first.select("exception_id", *(f"x.{c}" for c in COLUMNS[1:]))


def clusters(exceptions: DataFrame) -> DataFrame:
    """Root causes: category, rule, direction and band with count, gross and net impact and an example.

    The example is the largest impact (ties: smaller id). Ids are counted, not collected: a cluster may be a third of
    all exceptions.
    """
    rule = F.when(F.startswith("classified_by", F.lit("rule:")), F.substring_index("classified_by", "rule:", -1)).otherwise(F.coalesce("classified_by", F.lit("unclassified")))
    keyed = exceptions.select(F.col("category"), rule.alias("rule_id"), direction("impact").alias("direction"), impact_band("impact").alias("band"), "impact", "exception_id")
    return keyed.groupBy("category", "rule_id", "direction", "band").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.abs("impact")).alias("gross_impact"),
        F.sum("impact").alias("net_impact"),
        F.min(F.struct((-F.abs("impact")).alias("i"), "exception_id")).alias("e"),
    ).select("category", "rule_id", "direction", "band", "count", "gross_impact", "net_impact", F.col("e.exception_id").alias("example_id"))


#: Categories that hold a batch's money back, and their rank among all (others rank like UNEXPLAINED).
HELD = ["CHARGEBACK", "WRONG_ACCOUNT", "PARTIAL_PAYMENT", "DUPLICATE", "MISSING_UTR", "SECURITY_REVIEW"]


def cash_position(batches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Net per bucket: in transit, held, unexplained, confirmed; the buckets add up to the net of all batches.

    A batch goes by its gravest exception (ties: larger impact, then id). Without one that places it, it is confirmed
    if it ties within rounding and the ledger agrees.
    """
    rank = F.when(F.col("category").isin(HELD), 3).when(F.col("category") == "TIMING", 1).otherwise(2)
    worst = exceptions.where("batch_key is not null").groupBy("batch_key").agg(F.min(F.struct((-rank).alias("r"), (-F.abs("impact")).alias("i"), "exception_id", "category")).alias("w"))
    x = batches.join(worst.select("batch_key", F.col("w.category").alias("category")), "batch_key", "left")
    clean = F.coalesce(F.abs(F.coalesce("tied", "residual")) <= ROUNDING, F.lit(False)) & F.col("ledger_ok")
    bucket = F.when(F.col("category") == "TIMING", "in_transit").when(F.col("category").isin(HELD), "held").when((F.col("category") == "UNEXPLAINED") | ~clean, "unexplained").otherwise("confirmed")
    return x.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("batches"), F.sum("net").alias("net"))


def carry_forward(orphans: DataFrame, prior: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Orphan credits (credit_id, utr, amount) to batches left open before (settlement_utr, net_minor, from_run_id).

    The reference decides first, then the amount within tolerance; of several the first run (by id), then reference.
    """
    p = prior.groupBy("settlement_utr", "from_run_id").agg(F.max("net_minor").alias("net_minor"))
    by_ref = orphans.join(p, orphans["utr"] == p["settlement_utr"]).withColumn("how", F.lit(0))
    slots = p.withColumn("slot", F.explode(F.sequence(F.floor(F.col("net_minor") / tolerance) - 1, F.floor(F.col("net_minor") / tolerance) + 1)))
    by_amount = orphans.withColumn("slot", F.floor(F.col("amount") / tolerance)).join(slots, "slot").where(F.abs(F.col("amount") - F.col("net_minor")) <= tolerance).withColumn("how", F.lit(1)).drop("slot")
    x = by_ref.unionByName(by_amount.select(*by_ref.columns))
    best = x.groupBy("credit_id").agg(F.min(F.struct("how", "from_run_id", "settlement_utr", "net_minor")).alias("b"))
    return best.select("credit_id", F.when(F.col("b.how") == 0, "reference").otherwise("amount").alias("tied_by"), "b.from_run_id", "b.settlement_utr", "b.net_minor")


def top_exceptions(exceptions: DataFrame, per: str, k: int) -> DataFrame:
    """The k largest of each ``per``, by absolute impact then id (a report; the register itself is whole)."""
    w = Window.partitionBy(per).orderBy(F.desc(F.abs("impact")), "exception_id")
    return exceptions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score(anomalies: DataFrame, records: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: reviewed anomalies, those that an exception touches, those with the right category, and their share.

    ``anomalies`` (id, true_category, ids of records), ``records`` (rid, run_id, utr), ``exceptions`` (run_id, utr,
    category). An anomaly of several records counts once; without any exception the share is null.
    """
    touched = anomalies.select("id", "true_category", F.explode("ids").alias("rid")).join(records, "rid").join(exceptions, ["run_id", "utr"])
    hits = touched.groupBy("id").agg(F.max((F.col("category") == F.col("true_category")).cast("int")).alias("ok"))
    x = hits.agg(F.count(F.lit(1)).alias("detected"), F.coalesce(F.sum("ok"), F.lit(0)).alias("right_category"))
    all_ = anomalies.agg(F.count(F.lit(1)).alias("anomalies"))
    # Two single rows side by side.
    return all_.join(F.broadcast(x), F.lit(True)).withColumn("category_accuracy", F.round(F.try_divide("right_category", "detected"), 4))
