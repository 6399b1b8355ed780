"""Loaded rows to canonical records: one projection per source, driven by a small mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import money as M
from ..functions import refs as R

#: External ids that are kept, fields that are untrusted text, the order in which amounts are looked for.
EXTERNAL = ["entity_id", "settlement_utr", "settlement_id", "payment_id", "order_id", "order_receipt", "dispute_id", "account_no"]
UNTRUSTED = ["description", "notes", "narration", "remarks"]
AMOUNTS = ["amount", "gross_amount", "order_total", "credit"]
KINDS = ["payment", "refund", "adjustment", "chargeback", "transfer", "credit", "order"]
DEFAULT_KIND = {"bank": "credit", "ledger": "order"}
#: Sources whose amounts are minor units already.
MINOR_SOURCES = ["processor_recon"]


def _cell(name: str) -> Column:
    return F.nullif(F.trim(F.element_at("cells", name)), F.lit(""))


def normalize(loaded: DataFrame, sources: DataFrame, fx_rate: DataFrame, run_id: str) -> DataFrame:
    """Canonical records of loaded rows (line_id, file_hash, line_no, cells), with ``error`` where one cannot be made.

    ``sources`` gives file_hash, source and org_id. Rows without amount, without any date, with an implausible date or
    with a currency that has no rate come out with the reason in ``error``. Foreign amounts are converted half to even
    and keep their original in the external ids. Card numbers in untrusted text are masked and the row is flagged.

    Many files have no id column and all of a run share ``run_id``, so ``id`` is made of tenant, source, entity id and
    ``content`` (a hash of the row's cells, trimmed, without blanks): rows share an id only if they are equal.
    """
    x = loaded.join(sources.select("file_hash", "source", "org_id"), "file_hash")
    amount_text = F.coalesce(*(_cell(a) for a in AMOUNTS))
    debit = _cell("debit")
    is_minor = F.col("source").isin(MINOR_SOURCES)
    read = lambda c: F.when(is_minor, M.already_minor(c)).otherwise(M.to_minor(c))
    debited = debit.isNotNull() & ~debit.isin("0", "0.0", "0.00")
    signed = F.when(debited, -F.abs(read(debit))).otherwise(read(amount_text))
    x = x.withColumn("_amount", signed).withColumn("_currency", F.upper(F.coalesce(_cell("currency"), F.lit("INR"))))
    rates = fx_rate.select(F.upper(F.trim("currency")).alias("_currency"), F.col("rate_to_inr").alias("_rate")).dropDuplicates(["_currency"])
    x = x.join(F.broadcast(rates), "_currency", "left")
    value, posted, settled = D.parse_date(F.coalesce(_cell("value_date"), _cell("order_date"), _cell("date"))), D.parse_date(_cell("posted_date")), D.parse_date(_cell("settled_at"))
    x = x.withColumns({"value_date": value, "posted_date": posted, "settled_at": settled})
    odd = F.lit(False)
    for c in ("value_date", "posted_date", "settled_at"):
        odd = odd | F.coalesce(~D.plausible(c), F.lit(False))
    error = (
        F.when(amount_text.isNull() & ~debited, "missing amount")
        .when(F.col("_amount").isNull(), "unreadable amount")
        .when(F.col("_rate").isNull(), F.concat(F.lit("no rate for "), F.col("_currency")))
        .when(F.coalesce("value_date", "settled_at", "posted_date").isNull(), "no date")
        .when(odd, "implausible date")
    )
    foreign = F.col("_currency") != "INR"
    amount = F.when(foreign, M.fx_convert("_amount", "_rate")).otherwise(F.col("_amount"))
    kind = F.lower(_cell("type"))
    default = F.lit("payment")
    for s, k in DEFAULT_KIND.items():
        default = F.when(F.col("source") == s, k).otherwise(default)
    kind = F.when(kind.isin(KINDS), kind).when(kind.isNotNull(), "adjustment").otherwise(default)
    pairs = [(F.lit(k), _cell(k)) for k in EXTERNAL]
    pairs += [(F.lit("utr"), F.when(F.col("source") == "bank", R.extract_utr(_cell("narration"))))]
    pairs += [(F.lit("fx_orig_currency"), F.when(foreign, F.col("_currency"))), (F.lit("fx_orig_amount_minor"), F.when(foreign, F.col("_amount").cast("string")))]
    external = F.map_filter(F.create_map(*[c for p in pairs for c in p]), lambda k, v: v.isNotNull())
    untrusted = F.map_filter(F.create_map(*[c for n in UNTRUSTED for c in (F.lit(n), R.scrub_cards(_cell(n)))]), lambda k, v: v.isNotNull())
    identity = F.coalesce(_cell("entity_id"), _cell("id"), F.lit(""))
    filled = F.filter(F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].alias("k"), F.trim(e["value"]).alias("v"))), lambda e: e["v"] != "")
    x = x.withColumn("content", F.sha2(F.to_json(F.array_sort(filled)), 256))
    fee = lambda n: F.coalesce(F.when(is_minor, M.already_minor(_cell(n))), F.lit(0)).cast("bigint")
    return x.select(
        F.substring(F.sha2(F.concat_ws("|", F.coalesce("org_id", F.lit("")), "source", identity, "content", F.lit(run_id)), 256), 1, 16).alias("id"),
        F.lit(run_id).alias("run_id"),
        "org_id",
        "source",
        kind.alias("kind"),
        amount.alias("amount_minor"),
        fee("fee").alias("fee_minor"),
        fee("tax").alias("tax_minor"),
        F.when(foreign, "INR").otherwise(F.col("_currency")).alias("currency"),
        "value_date",
        "posted_date",
        "settled_at",
        F.coalesce(_cell("customer_name"), _cell("counterparty")).alias("counterparty"),
        R.normalize_reference(F.coalesce(_cell("reference"), _cell("narration"), _cell("order_id"), _cell("settlement_utr"))).alias("reference"),
        external.alias("external_ids"),
        untrusted.alias("untrusted"),
        F.col("cells").alias("raw"),
        F.exists(F.map_values("cells"), lambda v: F.size(R.card_runs(v)) > 0).alias("card_found"),
        F.col("file_hash").alias("ingest_file_hash"),
        error.alias("error"),
        "line_id",
        "content",
    )
