"""The whole cascade against a plain loop: the pool passes are walked one id after the other, SQL does the rest."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
import pytest

from ledgerloom import queries as core
from ledgerloom.operators import matching as M
from ledgerloom.queries import analysis, matching
from oracle import connect, rows

SF = "/root/testdata/sf0.01"


def one_combination(items, sizes, target):
    """The only combination within tolerance, sizes in turn; None if there is none or another."""
    found = []
    for n in sizes:
        found += [c for c in combinations(items, n) if abs(sum(v for _, v in c) - target) <= 200]
        if len(found) > 1:
            return None
    return found[0] if found else None


def plain_pools(con) -> dict[str, list]:
    """What the aggregate, split and subset passes take, walked over the ids in their order."""
    sql = f"with {matching.BLOCKED_ONLY} "
    batches = [(str(k), v) for k, v in con.execute(sql + "select batch_key, net from closed where match_pass is null and outcome = 'no_credit' order by cast(batch_key as varchar)").fetchall()]
    credits = con.execute(sql + "select credit_id, amount from open_credit order by credit_id").fetchall()
    pays = con.execute(sql + "select distinct payment_id, batch_key, amount - fee - tax as net from proc where kind = 'payment' and batch_key in (select batch_key from closed where match_pass is null) order by payment_id, net").fetchall()
    gone_b, gone_c, gone_p, passes, tied = set(), set(), set(), [], {}
    for cid, amount in credits:
        pool = [x for x in batches if x[0] not in gone_b][:14]
        if hit := one_combination(pool, (2, 3, 4), amount):
            passes.append(("aggregate", (cid,), tuple(k for k, _ in hit)))
            gone_c.add(cid)
            gone_b |= {k for k, _ in hit}
            tied |= {k: 0 for k, _ in hit}
    for key, net in batches:
        if key in gone_b:
            continue
        pool = [x for x in credits if x[0] not in gone_c][:10]
        if hit := one_combination(pool, (2, 3), net):
            passes.append(("split", tuple(k for k, _ in hit), (key,)))
            gone_c |= {k for k, _ in hit}
            gone_b.add(key)
            tied[key] = sum(v for _, v in hit) - net
    for cid, amount in credits:
        if cid in gone_c:
            continue
        left = [x for x in pays if x[0] not in gone_p and str(x[1]) not in gone_b][:40]
        # The subset search itself is tested by itself against all subsets.
        if hit := M.subset_sum([(i, x[2]) for i, x in enumerate(left)], amount, 200):
            passes.append(("subset", (cid,), tuple(sorted(left[i][0] for i in hit))))
            gone_c.add(cid)
            gone_p |= {left[i][0] for i in hit}
    return {"passes": passes, "batches": list(tied.items()), "credits": sorted(gone_c), "payments": sorted(gone_p)}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def pools(duck):
    found = plain_pools(duck)
    duck.register("took_batch", pd.DataFrame([(int(k), int(v)) for k, v in found["batches"]], columns=["batch_key", "tied"]).astype("int64"))
    duck.register("took_credit", pd.DataFrame({"credit_id": found["credits"]}, dtype="str"))
    duck.register("took_payment", pd.DataFrame({"payment_id": found["payments"]}, dtype="str"))
    return found


POOLS = "pool_batch as (select * from took_batch), pool_credit as (select * from took_credit), pool_payment as (select * from took_payment)"


def test_pool_passes_equal_a_plain_loop(spark, pools):
    got = core.queries()["pool_passes"](spark, SF).collect()
    assert pools["passes"], "the data must exercise the passes"
    key = lambda r: (r["pass"], tuple(sorted(r["credits"])), tuple(sorted(r["members"])))
    assert sorted(map(key, got)) == sorted((p, tuple(sorted(c)), tuple(sorted(m))) for p, c, m in pools["passes"])


@pytest.mark.parametrize("name", [*analysis.POOLED, "fuzzy_top3"])
def test_read_models_after_all_passes(spark, duck, pools, name):
    sql = matching.FUZZY_SQL if name == "fuzzy_top3" else analysis.POOLED[name]
    df = core.queries()[name](spark, SF)
    ints = [c for c, t in df.dtypes if t in ("int", "bigint")]
    got, want = df.toPandas(), duck.execute(sql.replace("{pools}", POOLS)).fetchdf()
    assert len(got) and rows(got, ints) == rows(want, ints)


def test_each_side_is_in_one_match_and_none_of_it_in_the_register(spark):
    from pyspark.sql import functions as F

    done, register = analysis._register(spark, SF)
    for side in ("batches", "payments", "credits"):
        x = done.matches.select(F.explode(side).alias("k"))
        assert x.count() == x.distinct().count()
    matched = done.matches.select(F.explode("batches").alias("key")).select(F.col("key").cast("bigint").alias("batch_key"))
    assert register.where("producer in ('missing', 'duplicate')").join(matched, "batch_key").count() == 0
    used = done.matches.select(F.explode("credits").alias("subject"))
    assert register.where("producer = 'orphan'").join(used, "subject").count() == 0
    kinds = {(r["producer"], r["category"]) for r in register.select("producer", "category").distinct().collect()}
    assert {p for p, _ in kinds} == {"security", "residual", "ledger", "chargeback", "duplicate", "missing", "orphan", "unmapped"}
    assert {"FX_DIFFERENCE", "FEE_DEDUCTION", "PARTIAL_PAYMENT", "UNEXPLAINED", "TIMING", "WRONG_ACCOUNT"} <= {c for _, c in kinds}
    assert register.where("category = 'TIMING' and producer = 'orphan'").count() > 0


def test_status_and_empty_inputs(spark, sf):
    q = core.queries()
    assert {r["status"] for r in q["cascade_matches"](spark, sf).where("match_pass = 'exact'").select("status").collect()} == {"auto"}
    assert q["cascade_matches"](spark, sf).where("status = 'auto' and confidence < 0.9").count() == 0
    lines, b, c, led = matching._views(spark, sf)
    none = matching.C.run(b.limit(0), c.limit(0), lines.limit(0), led.limit(0))
    assert none.matches.count() == none.batches.count() == none.credits.count() == 0
