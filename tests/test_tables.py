"""Cut points: what the driver holds of them must not grow with the rounds of a loop."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.tables import Latest, cut


def test_rounds_of_cuts_carry_no_estimates_or_constraints(spark):
    x = cut(spark.range(5).select("id", F.col("id").alias("label")))
    for _ in range(5):
        moves = cut(x.join(x.select(F.col("label").alias("id"), F.col("id").alias("r")), "id").where("r >= 0").select("id", "r"))
        x = cut(x.join(moves, "id", "left").select("id", F.coalesce("r", "label").alias("label")))
        plan = x._jdf.queryExecution().optimizedPlan()
        assert int(str(plan.stats().sizeInBytes())).bit_length() <= 64
        assert plan.constraints().size() == 0
    assert sorted(map(tuple, x.collect())) == [(i, i) for i in range(5)]
    assert x.schema.simpleString() == "struct<id:bigint,label:bigint>"


def test_rounds_leave_the_files_of_the_latest_only(spark):
    latest, x, paths = Latest("rounds"), spark.range(5).select("id"), []
    for _ in range(3):
        x = latest.keep(x.select(F.col("id") + 1))
        x = x.toDF("id")
        paths.append(Path(latest.path))
    assert [p.exists() for p in paths] == [False, False, True]
    assert sorted(r["id"] for r in x.collect()) == [3, 4, 5, 6, 7]
