"""Fuzzy candidates against the full cross product; pool passes over long partitions."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_level
from ledgerloom.functions.money import amount_level
from ledgerloom.operators import fs
from ledgerloom.operators import matching as M

DAY = dt.date(2025, 1, 1)


def fuzzy_inputs(spark, batches, credits):
    day = lambda n: None if n is None else DAY + dt.timedelta(days=n)
    b = spark.createDataFrame([(k, n, day(d)) for k, n, d in batches], "batch_key bigint, net bigint, settled_at date")
    c = spark.createDataFrame([(k, a, day(d)) for k, a, d in credits], "credit_id string, amount bigint, value_date date")
    return b, c


def test_fuzzy_same_day_before_near_amount(spark):
    b, c = fuzzy_inputs(spark, [(1, 100500, 300), (2, 700000, 0), (3, -5, 300), (4, 5, 300)], [("c", 100000, 0)])
    # 2 is far in amount on the same day (-2.862), 1 within 1 % but far in days (-7.451), 3 far in both (-11.451).
    assert [r["batch_key"] for r in M.fuzzy_top(b, c).orderBy("rank").collect()] == [2, 1, 3]


def test_fuzzy_equals_cross_product(spark):
    rng = random.Random(11)
    base = [0, 1, -1, 150, 19_900, 20_100, -20_000, 1_000_000, -3_000_000, 123_456_789, -123_456_789]
    near = lambda: int(rng.choice(base) * rng.choice([1, 1, 1, 0.99, 1 / 0.99, 0.995, 1.0101, 1.02])) + rng.choice([0, 0, 1, -1, 100, 101, -200, 201])
    day = lambda: rng.choice([None, *range(0, 60)])
    batches = [(k, near(), day()) for k in rng.sample(range(10_000), 500)]
    credits = [(f"c{k}", near(), day()) for k in range(200)]
    b, c = fuzzy_inputs(spark, batches, credits)
    bits = fs.weight({"amount": amount_level("amount", "net", M.ROUNDING, M.TOLERANCE), "date": date_level("value_date", "settled_at", M.WINDOW), "reference": F.lit("none"), "idlink": F.lit("none")})
    top = Window.partitionBy("credit_id").orderBy(F.desc("score_bits"), F.col("batch_key").cast("string"))
    x = c.crossJoin(b).withColumn("score_bits", F.round(bits, 3)).withColumn("rank", F.row_number().over(top)).where("rank <= 3")
    key = lambda df: sorted((r["credit_id"], r["rank"], r["batch_key"], r["score_bits"]) for r in df.collect())
    assert key(M.fuzzy_top(b, c)) == key(x)
    # A bit more for the same party, which a third of all rows share.
    party = lambda key: F.when(F.xxhash64(key) % 3 == 0, "hot").when(F.xxhash64(key) % 50 != 0, F.concat(F.lit("p"), F.pmod(F.xxhash64(key), F.lit(40))))
    b2, c2 = b.withColumn("party", party("batch_key")), c.withColumn("party", party("credit_id"))
    more = F.when(F.col("party") == F.col("b_party"), 1.0).otherwise(0.0)
    y = c2.crossJoin(b2.withColumnRenamed("party", "b_party")).withColumn("score_bits", F.round(bits + more, 3)).withColumn("rank", F.row_number().over(top)).where("rank <= 3")
    assert key(M.fuzzy_top(b2, c2)) == key(y)
    assert M.fuzzy_top(b, c.limit(0)).count() == 0
    assert M.fuzzy_top(b.limit(0), c).count() == 0


def pool_run(spark, batches, credits, payments):
    b = spark.createDataFrame([("r", k, v) for k, v in batches], "part string, batch_key bigint, net bigint")
    c = spark.createDataFrame([("r", k, v) for k, v in credits], "part string, credit_id string, amount bigint")
    p = spark.createDataFrame([("r", *x) for x in payments], "part string, payment_id string, batch_key bigint, amount bigint")
    return [(r["pass"], r["credits"], sorted(r["members"]), r["residual"]) for r in M.pool_pass(b, c, p, ["part"]).collect()]


def test_pools_refill_until_every_id_is_tried(spark):
    # 80 batches, each pair paid by one credit; 100 credits that fit nothing come first.
    batches = [(1000 + k, 1_000_000 + 7**6 * k * k) for k in range(80)]
    idle = [(f"a{k:03}", 10**12 + 10**6 * k) for k in range(100)]
    paid = [(f"b{k:03}", batches[2 * k][1] + batches[2 * k + 1][1]) for k in range(40)]
    got = pool_run(spark, batches, idle + paid, [])
    assert got == [("aggregate", [c], [str(1000 + 2 * k), str(1001 + 2 * k)], 0) for k, (c, _) in enumerate(paid)]


def test_subsets_beyond_the_first_payments(spark):
    payments = [(f"p{k:03}", None, 10**6 + 1000 * k) for k in range(100)]
    credits = [(f"c{k:03}", v) for k, (_, _, v) in enumerate(payments)]
    got = pool_run(spark, [], credits, payments)
    assert got == [("subset", [f"c{k:03}"], [f"p{k:03}"], 0) for k in range(100)]


def test_payments_of_taken_batches_leave(spark):
    got = pool_run(spark, [(1, 3000), (2, 5000)], [("c1", 8000), ("c2", 3000)], [("p1", 1, 3000), ("p2", 9, 70000)])
    assert got == [("aggregate", ["c1"], ["1", "2"], 0)]


def test_lines_of_one_payment_id(spark):
    got = pool_run(spark, [], [("c1", 3000), ("c2", 9000)], [("p1", 1, 3000), ("p1", 1, 9000), ("p2", 1, 50000)])
    assert got == [("subset", ["c1"], ["p1"], 0)]


def test_pool_passes_leave_matched_ids_alone(spark, sf):
    from ledgerloom import queries as core

    q = core.queries()
    rows = q["pool_passes"](spark, sf).collect()
    taken = {r["credit_id"] for r in q["blocked_greedy"](spark, sf).collect()}
    assert not taken & {c for r in rows for c in r["credits"]}
    matched = {str(r["batch_key"]) for r in q["utr_match_outcome"](spark, sf).where("outcome in ('exact', 'tolerant')").collect()}
    assert not matched & {m.split("_")[1] for r in rows if r["pass"] == "subset" for m in r["members"]}
