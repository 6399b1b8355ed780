"""Evidence around a case: counterparty history, training pairs, pattern recall, regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metrics that must not get worse, their direction and what is tolerated.
GATE = [("recall", "up", 0.02), ("precision", "up", 0.02), ("money_coverage", "up", 0.01), ("false_match_rate", "down", 0.005)]


def history(records: DataFrame, entity: Column, order: list[str], k: int = 25) -> DataFrame:
    """The first ``k`` records of each entity in ``order``; a report, the records themselves stay whole."""
    x = records.withColumn("entity", entity).where("entity <> ''")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where(F.col("rank") <= k)


def shifted_pairs(matches: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Positive pairs (left, right) of the matches and negatives that pair each left with the next match's right.

    The last match takes the first one's right. The shift runs over key order within 64 ranges of the key's hash, so
    no single task sorts all matches.
    """
    x = matches.select(key, left, right).withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    w = Window.partitionBy("part").orderBy(key)
    nxt = F.coalesce(F.lead(right).over(w), F.first(right).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shifted = x.withColumn("other", nxt).where(F.col("other") != F.col(right)).select(key, left, F.col("other").alias(right), F.lit(False).alias("is_match"))
    return x.select(key, left, right, F.lit(True).alias("is_match")).unionByName(shifted)


def recall_patterns(cases: DataFrame, library: DataFrame) -> DataFrame:
    """The action most often taken for the case's shape; without that shape, for its category and band.

    ``cases``: case_id, shape_key, category, band; ``library``: shape_key, category, band, action, contributor. Of
    equally frequent actions the one with more contributors, then the smaller name.
    """

    def best(keys: list[str]) -> DataFrame:
        per = library.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("contributor").alias("tenants"))
        return per.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("a"), (-F.col("tenants")).alias("b"), "action")).alias("x"))

    exact, near = best(["shape_key"]), best(["category", "band"])
    x = cases.join(exact.withColumnRenamed("x", "e"), "shape_key", "left").join(near.withColumnRenamed("x", "f"), ["category", "band"], "left")
    pick = F.coalesce("e", "f")
    how = F.when(F.col("e").isNotNull(), "shape").when(F.col("f").isNotNull(), "category")
    return x.select("case_id", how.alias("found_by"), pick["action"].alias("action"), (-pick["a"]).alias("occurrences"), (-pick["b"]).alias("tenants"))


def gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, ok) of the gated metrics that both sides have; one row each, in long form."""
    rules = current.sparkSession.createDataFrame(GATE, "metric string, direction string, tolerance double")
    x = F.broadcast(rules).join(baseline.select("metric", F.col("value").alias("baseline")), "metric").join(current.select("metric", F.col("value").alias("current")), "metric")
    worse = F.when(F.col("direction") == "up", F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    return x.select("metric", "baseline", "current", (F.round(worse, 9) <= F.col("tolerance")).alias("ok"))
