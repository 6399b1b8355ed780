"""Synthetic settlement data by seeded hash expressions: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payment methods with their share of orders and fee in basis points; tax on the fee in percent.
METHODS = [("upi", 0.55, 0), ("card", 0.30, 180), ("netbanking", 0.10, 150), ("wallet", 0.05, 200)]
TAX_PERCENT = 18


def unit(seed: int, *salt: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash of the seed and the salt."""
    return F.pmod(F.xxhash64(F.lit(seed), *salt), F.lit(1 << 40)) / F.lit(float(1 << 40))


def settled_on(day: Column, working_days: int = 2) -> Column:
    """The day this many working days (Monday to Friday) after ``day``."""
    out = day
    for _ in range(working_days):
        nxt = F.date_add(out, 1)
        out = F.date_add(nxt, F.when(F.dayofweek(nxt) == 7, 2).when(F.dayofweek(nxt) == 1, 1).otherwise(0))
    return out


def orders(spark: SparkSession, n: int, seed: int = 42, start: str = "2026-08-03", days: int = 30, partitions: int = 8) -> DataFrame:
    """Order ledger: order_id, order_total (minor units, log-normal), order_date, method, customer."""
    x = spark.range(0, n, 1, partitions)
    normal = F.sqrt(-2 * F.ln(F.greatest(unit(seed, F.lit("u1"), "id"), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * unit(seed, F.lit("u2"), "id"))
    pick, method, upto = unit(seed, F.lit("method"), "id"), F.lit(METHODS[-1][0]), 1.0
    for name, share, _ in reversed(METHODS[:-1]):
        upto = sum(s for m, s, _ in METHODS[: [m for m, *_ in METHODS].index(name) + 1])
        method = F.when(pick < upto, name).otherwise(method)
    return x.select(
        F.format_string("ord_%08d", "id").alias("order_id"),
        F.greatest(F.lit(4900), F.round(F.exp(7.0 + 0.9 * normal) * 100)).cast("bigint").alias("order_total"),
        F.date_add(F.lit(start).cast("date"), F.floor(unit(seed, F.lit("day"), "id") * days).cast("int")).alias("order_date"),
        method.alias("method"),
        F.format_string("customer %d", F.floor(unit(seed, F.lit("customer"), "id") * (n // 4 + 1)).cast("bigint")).alias("customer_name"),
    )


def processor_lines(order_rows: DataFrame, seed: int = 42, refund_share: float = 0.04) -> DataFrame:
    """Payments with fee and tax, settled two working days on, and refunds of a share of them."""
    bps = F.lit(0)
    for name, _, b in METHODS:
        bps = F.when(F.col("method") == name, b).otherwise(bps)
    fee = F.floor(F.col("order_total") * bps / 10_000).cast("bigint")
    pay = order_rows.select(
        F.concat(F.lit("pay_"), F.substring("order_id", 5, 20)).alias("entity_id"), F.lit("payment").alias("kind"), F.col("order_total").alias("amount"), fee.alias("fee"),
        F.floor(fee * TAX_PERCENT / 100).cast("bigint").alias("tax"), "order_id", "method", settled_on(F.col("order_date")).alias("settled_at"),
    )
    back = pay.where(unit(seed, F.lit("refund"), "order_id") < refund_share)
    zero = F.lit(0).cast("bigint")
    refunds = back.select(F.regexp_replace("entity_id", "^pay_", "rfnd_").alias("entity_id"), F.lit("refund").alias("kind"), (-F.col("amount")).alias("amount"), zero.alias("fee"), zero.alias("tax"), "order_id", "method", settled_on(F.col("settled_at"), 3).alias("settled_at"))
    both = pay.unionByName(refunds)
    return both.withColumn("settlement_utr", F.concat(F.lit("GEN"), F.date_format("settled_at", "yyyyMMdd"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "settled_at"), 256), 1, 8))))


def bank_credits(lines: DataFrame, seed: int = 42, lost_reference: float = 0.1) -> DataFrame:
    """One credit per settlement batch; a share of them lost the reference in the narration."""
    net = lines.groupBy("settlement_utr", "settled_at").agg(F.sum(F.col("amount") - F.col("fee") - F.col("tax")).alias("amount"))
    lost = unit(seed, F.lit("lost"), "settlement_utr") < lost_reference
    return net.select("amount", F.col("settled_at").alias("value_date"), F.concat(F.lit("NEFT CR SETTLEMENT"), F.when(lost, "").otherwise(F.concat(F.lit(" UTR "), "settlement_utr"))).alias("narration"), "settlement_utr")
