"""References to records that do not exist: one tagged long table of parent and child keys, one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import norm_key

#: Kinds whose external payment_id must lead to a payment.
CHILD_KINDS = ["refund", "adjustment", "chargeback"]


def parent_keys(df: DataFrame, scope: Column, key: Column, link: str) -> DataFrame:
    """Keys that exist, in long form: (link, scope, key, is_parent, ref_table, row_id, period)."""
    return df.select(
        F.lit(link).alias("link"),
        scope.alias("scope"),
        norm_key(key).alias("key"),
        F.lit(True).alias("is_parent"),
        F.lit(None).cast("string").alias("ref_table"),
        F.lit(None).cast("string").alias("row_id"),
        F.lit(None).cast("string").alias("period"),
    ).where("key is not null")


def child_keys(df: DataFrame, scope: Column, key: Column, link: str, ref_table: str, row_id: Column, period: Column) -> DataFrame:
    """References, in the same long form."""
    return df.select(
        F.lit(link).alias("link"),
        scope.alias("scope"),
        norm_key(key).alias("key"),
        F.lit(False).alias("is_parent"),
        F.lit(ref_table).alias("ref_table"),
        row_id.cast("string").alias("row_id"),
        period.cast("string").alias("period"),
    ).where("key is not null")


def orphans(long: DataFrame) -> DataFrame:
    """(ref_table, row_id, missing_key, period) of every reference whose (link, scope, key) group has no parent.

    Parents are first reduced to one row per key on the map side, references to one per row, so a key that holds a
    third of all rows costs one row per task in the shuffle. Only keys *without* a parent go on to carry their rows;
    that second step is an anti-join, so no group is ever collected. A null scope is a scope of its own in which no
    parent can exist. A reference with a blank key counts as null and is no case.
    """
    keys = long.groupBy("link", "scope", "key").agg(F.max("is_parent").alias("has_parent"))
    missing = keys.where("not has_parent").select("link", "scope", "key")
    refs = long.where("not is_parent").groupBy("link", "scope", "key", "ref_table", "row_id").agg(F.min("period").alias("period"))
    same = refs["scope"].eqNullSafe(missing["scope"]) & (refs["link"] == missing["link"]) & (refs["key"] == missing["key"])
    return refs.join(missing, same, "left_semi").select("ref_table", "row_id", F.col("key").alias("missing_key"), "period")


def reference_keys(recon_record: DataFrame, decomposition: DataFrame, gt_match: DataFrame, gt_anomaly: DataFrame, recon_run: DataFrame) -> DataFrame:
    """The long form of all settlement and payment references of the reconciliation tables.

    ``recon_run`` (one row per tenant and period) names the tenant of a run; a run that is not in it has no tenant,
    so its references are dangling.
    """
    runs = recon_run.groupBy("run_id").agg(F.max("org_id").alias("_org"), F.max("period").alias("_period"))
    utr = F.element_at("external_ids", "settlement_utr")
    pay = F.element_at("external_ids", "payment_id")
    month = F.coalesce(F.date_format("value_date", "yyyy-MM"), F.date_format("settled_at", "yyyy-MM"), F.lit("unknown"))
    # One pass over the records: each gives its settlement key and, by kind, a payment key as parent or as child.
    kid, none = F.col("kind").isin(CHILD_KINDS), F.lit(None).cast("string")
    entry = lambda link, key, parent, child: F.struct(
        F.lit(link).alias("link"), F.col("org_id").alias("scope"), norm_key(key).alias("key"), F.lit(parent).alias("is_parent"),
        F.lit("recon_record" if child else None).cast("string").alias("ref_table"), (F.col("id") if child else none).alias("row_id"), (month if child else none).alias("period"),
    )
    entries = F.array(entry("utr", utr, True, False), F.when(F.col("kind") == "payment", entry("payment", pay, True, False)), F.when(kid, entry("payment", pay, False, True)))
    out = recon_record.select(F.explode(entries).alias("x")).where("x is not null").select("x.*").where("key is not null")
    for name, df, rid in (("decomposition", decomposition, "group_id"), ("gt_match", gt_match, "group_id"), ("gt_anomaly", gt_anomaly, "id")):
        scoped = df.select("run_id", rid, "settlement_utr").join(runs, "run_id", "left")
        out = out.unionByName(child_keys(scoped, F.col("_org"), F.col("settlement_utr"), "utr", name, F.col(rid), F.coalesce("_period", F.lit("unknown"))))
    return out


def orphan_report(found: DataFrame) -> DataFrame:
    """Dangling references per table and period: how many, and how many different keys."""
    per_key = found.groupBy("ref_table", "period", "missing_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "period").agg(F.sum("n").alias("orphan_refs"), F.count(F.lit(1)).alias("missing_keys"))
