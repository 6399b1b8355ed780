"""Profiles, drift, calibration, ranking quality and threshold search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import running_sums

FEATURES = ["record_count", "source_count", "kind_count", "payment_frac", "credit_frac", "has_reference_frac", "has_counterparty_frac", "has_value_date_frac", "counterparty_cardinality", "amount_log_median", "amount_cv"]


def feature_profile(records: DataFrame, by: str) -> DataFrame:
    """Eleven features per ``by``. The median is the upper one; the variation is the population's over mean + 1.

    The median is an exact rank, found from counts per distinct amount, so no group is collected.
    """
    amounts = records.withColumn("_a", F.abs("amount_minor"))
    per = amounts.where("_a is not null").groupBy(by, "_a").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(per, [by], "_a", ["_n"]).withColumn("_upto", F.col("_n_before") + F.col("_n")).join(per.groupBy(by).agg(F.sum("_n").alias("_all")), by)
    median = ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(by).agg(F.min("_a").alias("_median"))
    frac = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    base = amounts.groupBy(by).agg(
        F.count(F.lit(1)).cast("double").alias("record_count"),
        F.countDistinct("source").cast("double").alias("source_count"),
        F.countDistinct("kind").cast("double").alias("kind_count"),
        frac(F.col("kind") == "payment").alias("payment_frac"),
        frac(F.col("kind") == "credit").alias("credit_frac"),
        frac(filled("reference")).alias("has_reference_frac"),
        frac(filled("counterparty")).alias("has_counterparty_frac"),
        frac(F.col("value_date").isNotNull()).alias("has_value_date_frac"),
        F.round(F.countDistinct(F.nullif("counterparty", F.lit(""))) / F.count(F.lit(1)), 6).alias("counterparty_cardinality"),
        F.round(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("_a") / (F.avg("_a") + 1)).otherwise(0.0), 6).alias("amount_cv"),
    )
    out = base.join(median, by, "left").withColumn("amount_log_median", F.round(F.log10(F.greatest(F.coalesce("_median", F.lit(1)), F.lit(1)) + 1), 6))
    return out.select(by, *FEATURES)


def psi(baseline: Column, current: Column) -> Column:
    """One bucket's population-stability term of two non-negative summaries taken as shares of their sum."""
    b, c = F.greatest(baseline, F.lit(1e-6)), F.greatest(current, F.lit(1e-6))
    pb, pc = b / (b + c), c / (b + c)
    return (pc - pb) * F.ln(pc / pb)


def drift(profiles: DataFrame, by: str, order: str) -> DataFrame:
    """Per profile the stability term of each feature against the mean of all earlier profiles (by ``order``)."""
    long = profiles.select(by, order, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))).alias("x")).select(by, order, "x.*")
    w = Window.partitionBy("feature").orderBy(order, by).rowsBetween(Window.unboundedPreceding, -1)
    x = long.withColumn("baseline", F.avg("value").over(w)).withColumn("runs_before", F.count("value").over(w))
    return x.withColumn("psi", F.round(psi(F.col("baseline"), F.col("value")), 6)).withColumn("alert", (F.col("runs_before") >= 3) & (F.col("psi") > 0.10))


def calibration_buckets(rows: DataFrame, confidence: str, correct: str, n: int = 10) -> DataFrame:
    """Equal-width buckets of stated confidence with their mean and accuracy."""
    bucket = F.least(F.floor(F.col(confidence) * n), F.lit(n - 1)).cast("int")
    return rows.where(F.col(confidence).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def expected_calibration_error(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def isotonic(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Pools neighbours that fall until the map rises; a pool keeps its left x. At most a handful of points."""
    pools: list[list[float]] = []
    for x, y in sorted(points):
        pools.append([x, y, 1.0])
        while len(pools) > 1 and pools[-2][1] > pools[-1][1]:
            _, y2, w2 = pools.pop()
            x1, y1, w1 = pools.pop()
            pools.append([x1, (y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2])
    return [(x, y) for x, y, _ in pools]


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by Mann-Whitney with half for ties, from counts per distinct score."""
    per = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((~F.col(label)).cast("bigint")).alias("neg"))
    x = running_sums(per, [], score, ["neg"]).withColumn("wins", F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    return x.agg(F.round(F.sum("wins") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def best_threshold(rows: DataFrame, score: str, label: str, low: float = 0.45, high: float = 0.90) -> DataFrame:
    """The smallest cut (a score rounded to 3 places) with the most right answers; clamped to [low, high]."""
    cut = F.round(score, 3)
    per = rows.where(F.col(score).isNotNull()).groupBy(cut.alias("cut"), (F.col(score) >= cut).alias("at_least")).agg(F.sum(F.col(label).cast("bigint")).alias("ok"), F.count(F.lit(1)).alias("n"))
    per = per.groupBy("cut").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.sum(F.when(~F.col("at_least"), F.col("ok")).otherwise(0)).alias("ok_below"), F.sum(F.when(~F.col("at_least"), F.col("n")).otherwise(0)).alias("n_below"))
    # Right answers of a cut: what is wrong below it and what is right from it on.
    x = running_sums(per.withColumn("wrong", F.col("n") - F.col("ok")), [], "cut", ["wrong", "ok"])
    all_ok = per.agg(F.sum("ok").alias("all_ok"))
    wrong_below = F.col("wrong_before") + F.col("n_below") - F.col("ok_below")
    right_above = F.col("all_ok") - F.col("ok_before") - F.col("ok_below")
    # One row beside every cut: a scalar, not a product of two tables.
    x = x.join(F.broadcast(all_ok), F.lit(True)).withColumn("right", wrong_below + right_above)
    return x.agg(F.max(F.struct("right", (-F.col("cut")).alias("c"))).alias("b")).select(F.round(F.greatest(F.lit(low), F.least(F.lit(high), -F.col("b.c"))), 3).alias("threshold"), F.col("b.right").alias("right"))


def majority(rows: DataFrame, by: str, choice: str, order: str) -> DataFrame:
    """The most frequent choice per ``by``; ties go to the one seen first in ``order``."""
    per = rows.where(F.col(choice).isNotNull()).groupBy(by, choice).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    return per.groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "first", choice)).alias("b")).select(by, F.col(f"b.{choice}").alias(choice), (-F.col("b.v")).alias("votes"))
