"""Operators of the llm subpackage against brute force, exact fixtures or held-out accuracy."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import abuse, entity_match, history, leaks, mixing, names, nearest

BASE = dt.datetime(2025, 3, 1, tzinfo=dt.UTC)


# -- nearest time ----------------------------------------------------------------------------------------------------
LEFT = "org string, acct string, lid string, t timestamp, amount bigint, rid string"
RIGHT = "org string, acct string, rid bigint, t timestamp, amount bigint, lid string"


def brute_nearest(left, right, tol_s=nearest.TOLERANCE_S, amt=nearest.AMOUNT_TOLERANCE):
    out = {}
    for o, a, lid, t, x, _ in left:
        fit = [(abs(t - r[3]), r[2]) for r in right if None not in (o, a, t, x) and (r[0], r[1]) == (o, a) and None not in r[:5] and abs(r[4] - x) <= amt and abs(t - r[3]).total_seconds() <= tol_s]
        if fit:
            out[lid] = min(fit)[1]
    return out


@pytest.mark.parametrize("spread", [3_000, 200_000, 3_000_000])
def test_nearest_against_brute_force(spark, spread):
    rng = random.Random(spread)
    when = lambda: BASE + dt.timedelta(seconds=rng.randrange(spread))
    left = [("o", rng.choice("ab"), f"l{i}", when(), rng.choice([1000, 1100, 1300, 5000]), "clash") for i in range(80)]
    right = [("o", rng.choice("ab"), i, when(), rng.choice([900, 1000, 1200, 5100]), "clash") for i in range(80)]
    left += [("o", "a", "tie", BASE + dt.timedelta(seconds=100), 77_000, ""), ("o", None, "n1", when(), 1, ""), ("o", "a", "n2", None, 1, ""), ("o", "a", "n3", when(), None, "")]
    right += [("o", "a", 500, BASE + dt.timedelta(seconds=50), 77_100, ""), ("o", "a", 400, BASE + dt.timedelta(seconds=150), 76_900, ""), ("o", "a", 401, BASE + dt.timedelta(seconds=150), 76_900, ""), (None, "a", 402, BASE, 77_000, "")]
    right += right[:5]  # repeated rows
    got = nearest.nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["org", "acct"])
    assert {r["lid"]: r["rid"] for r in got.collect()} == brute_nearest(left, right)


def test_nearest_edges(spark):
    left = [("o", "a", "in", BASE, 1000, ""), ("o", "a", "out", BASE + dt.timedelta(days=9), 1000, "")]
    right = [("o", "a", 1, BASE + dt.timedelta(hours=36), 1200, ""), ("o", "a", 2, BASE + dt.timedelta(days=7, hours=11, minutes=59, seconds=59), 1000, "")]
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert {x["lid"]: x["rid"] for x in nearest.nearest(l, r, ["org", "acct"]).collect()} == {"in": 1}
    assert nearest.nearest(l.limit(0), r, ["org", "acct"]).count() == nearest.nearest(l, r.limit(0), ["org", "acct"]).count() == 0


def test_nearest_hot_entity(spark):
    rows = 3000
    left = spark.range(rows).select(F.lit("o").alias("org"), F.lit("a").alias("acct"), F.col("id").cast("string").alias("lid"), F.timestamp_seconds(1_740_000_000 + F.col("id") * 7).alias("t"), F.lit(5).cast("bigint").alias("amount"))
    right = spark.range(rows).select(F.lit("o").alias("org"), F.lit("a").alias("acct"), F.col("id").alias("rid"), F.timestamp_seconds(1_740_000_003 + F.col("id") * 7).alias("t"), F.lit(5).cast("bigint").alias("amount"))
    got = nearest.nearest(left, right, ["org", "acct"]).collect()
    assert {(int(x["lid"]), x["rid"]) for x in got} == {(i, i) for i in range(rows)}


# -- belief propagation ----------------------------------------------------------------------------------------------
def test_propagation_is_exact_on_trees_and_close_on_loops(spark):
    rng = random.Random(2)

    def exact(pairs):
        total, share = 0.0, dict.fromkeys(pairs, 0.0)
        items = list(pairs)
        for k in range(len(items) + 1):
            for c in itertools.combinations(items, k):
                if len({i for i, _ in c}) == len(c) == len({j for _, j in c}):
                    w = math.prod(math.exp(pairs[p]) for p in c)
                    total += w
                    for p in c:
                        share[p] += w
        return {p: s / total for p, s in share.items()}

    tree = {("a", 1): 1.0, ("a", 2): 0.5, ("b", 2): 2.0, ("c", 9): 0.3}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in tree.items()] + [("a", 1, -9.0), (None, 1, 1.0)], "i string, j int, score double")
    got = {(r["i"], r["j"]): r["confidence"] for r in entity_match.propagate(df, "i", "j").collect()}
    for p, want in exact(tree).items():
        assert got[p] == pytest.approx(want, abs=2e-3)
    loop = {(i, j): rng.uniform(-1, 2) for i in range(3) for j in range(3)}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in loop.items()], "i int, j int, score double")
    got = {(r["i"], r["j"]): r["confidence"] for r in entity_match.propagate(df, "i", "j").collect()}
    for p, want in exact(loop).items():
        assert got[p] == pytest.approx(want, abs=0.12)
    assert entity_match.propagate(df.limit(0), "i", "j").count() == 0


def test_propagation_says_when_it_has_not_settled(spark):
    df = spark.createDataFrame([(i, j, 12.0) for i in range(2) for j in range(2)], "i int, j int, score double")
    with pytest.raises(entity_match.NotSettledError):
        entity_match.propagate(df, "i", "j", rounds=4)
    # Two lines and two records that fit alike: each pair gets about a half.
    got = entity_match.propagate(df, "i", "j").collect()
    assert all(r["rivals"] == 2 and r["confidence"] == pytest.approx(0.5, abs=0.05) for r in got)


def test_the_driver_plans_nothing_for_a_round(spark):
    """Components that need many more rounds take no more jobs; in a task and round by round they come out alike."""
    jobs = lambda: spark._jsc.sc().dagScheduler().numTotalJobs()
    pairs = [(i, f"r{i + d}", 4.0 + d / 10) for i in range(12) for d in (0, 1)] + [(i, f"s{j}", 3.0) for i in (50, 51) for j in (1, 2)] + [(60, "t", -1.0), (61, "t", 2.0), (70, "u", 1.0)]
    df = spark.createDataFrame(pairs, "i int, j string, score double")
    taken, got = {}, {}
    for tolerance in (0.3, 1e-6):
        before = jobs()
        got = {(r["i"], r["j"]): (r["confidence"], r["rivals"]) for r in entity_match.propagate(df, "i", "j", tolerance=tolerance).collect()}
        taken[tolerance] = jobs() - before
    with pytest.raises(entity_match.NotSettledError):
        entity_match.propagate(df, "i", "j", rounds=10, tolerance=1e-6)
    assert taken[1e-6] <= taken[0.3] + 3
    assert len(got) == len(pairs)
    for r in entity_match.propagate(df, "i", "j", tolerance=1e-6, in_task=3).collect():
        assert got[r["i"], r["j"]] == (pytest.approx(r["confidence"], abs=1e-4), r["rivals"])


def test_contested_pairs_go_by_marginals(spark):
    """Rivals reach the propagation, and the better of them wins; a tie between equals is nobody's."""
    d = dt.date(2025, 5, 1)
    row = lambda i, ref, name, amount=100000, day=d: (i, "o", "ledger", "order", amount, day, None, ref, name, BASE)
    rec = [row("r1", "BILL123456", "Zobemalibu Traders"), row("r2", "BILL123465", "Zobemalibu Traders"), row("r3", "PO 777777", "Kotulavipe Mart", 500000), row("r4", "PO 888888", "Kotulavipe Mart", 500000)]
    rec += [row("r5", "SO-515151", "Fitorunozas Ltd", 1000000), row("r6", "SO-616161", "Lumakidero Ltd", 200000, d - dt.timedelta(days=70))]
    line = lambda k, amount, text, day="2025-05-04": (k, "o", amount, day, "", text, "", "c")
    lines = [line(1, "1,000.00", "NEFT CR BILL123456 ZOBEMALIBU"), line(2, "1000.00", "UPI BILL123465 ZOBEMALIBU"), line(3, "5000.00", "IMPS KOTULAVIPE")]
    # A charge that is none of the usual ones, and a payment long after the order, both with the reference.
    lines += [line(4, "9958.00", "NEFT CR SO515151 FITORUNOZAS"), line(5, "2000.00", "NEFT CR SO616161 LUMAKIDERO", "2025-05-20")]
    m = entity_match.match(spark.createDataFrame(lines, LINE), spark.createDataFrame(rec, REC)).cache()
    assert {(r["bank_line_id"], r["record_id"]) for r in m.where("confidence > 0.5").collect()} == {(1, "r1"), (2, "r2"), (4, "r5"), (5, "r6")}
    tied = {r["record_id"]: r["confidence"] for r in m.where("bank_line_id = 3").collect()}
    assert set(tied) == {"r3", "r4"} and all(0.3 < x <= 0.5 for x in tied.values())
    assert m.where("bank_line_id in (1, 2) and rivals > 0").count() == 4


REC = "id string, org_id string, source string, kind string, amount_minor bigint, value_date date, posted_date date, reference string, counterparty string, ingested_at timestamp"
LINE = "bank_line_id bigint, org_id string, amount string, value_date string, posted_date string, narration string, account_no string, id string"


def test_lines_to_records(spark):
    d = dt.date(2025, 5, 1)
    rec = [
        ("r1", "o", "ledger", "order", 100000, d, None, "INV/2526/123456", "Mohammed Zobemalibu", BASE),
        ("r2", "o", "ledger", "order", 100000, d, None, "BILL654321", "Rajendra Kotulavipe", BASE),
        ("r3", "o", "ledger", "order", 250000, d, None, "PO 111222/3", "Fitorunozas Garments Ltd", BASE),
        ("r3", "o", "ledger", "order", 250000, d, None, "PO 111222/3", "Fitorunozas Garments Ltd", BASE + dt.timedelta(days=9)),
        ("r4", "x", "ledger", "order", 77000, None, None, None, None, BASE),
    ]
    lines = [
        (1, "o", "1,000.00", "2025-05-04", "", "NEFT CR MOHD ZOBEMALIBU", "", "c"),  # name and amount
        (2, "o", "+988.20", "05/05/2025", None, "UPI/BILL654321/R KOTULAVIPE", "", "c"),  # reference, fee taken off
        (3, "o", "2500.00", "2025-04-30", "", "IMPS FITORUNOZAS GARMENTS", "", "c"),  # before the order
        (4, "o", "1000.00", "2025-05-04", "", "CASH DEPOSIT BRANCH", "", "c"),  # a like amount alone
        (5, "o", "17.00", "2025-05-04", "", "NEFT CR MOHD ZOBEMALIBU", "", "c"),  # a like name alone
        (6, None, "1000.00", "2025-05-04", "", None, "", "c"),
        (7, "o", "abc", "never", "", "x", "", "c"),
        (1, "o", "1,000.00", "2025-05-04", "", "NEFT CR MOHD ZOBEMALIBU", "", "c"),
        (8, "x", "770.00", "2025-05-04", "", "UPI " + "LONG " * 2000, "", "c"),
    ]
    m = entity_match.match(spark.createDataFrame(lines, LINE), spark.createDataFrame(rec, REC))
    assert {(r["bank_line_id"], r["record_id"]) for r in m.where("confidence > 0.5").collect()} == {(1, "r1"), (2, "r2")}
    assert entity_match.match(spark.createDataFrame([], LINE), spark.createDataFrame(rec, REC)).count() == 0


# -- history ---------------------------------------------------------------------------------------------------------
MOVE = "id string, org_id string, source string, kind string, amount_minor bigint, fee_minor bigint, value_date date, counterparty string, external_ids map<string,string>, raw map<string,string>, ingested_at timestamp, ingest_batch int, content string"


def move(i, load, amount=1000, moment="1", order="ord_000001", pay="pay_000001", org="o", kind="payment", utr="U"):
    ids = {k: v for k, v in {"order_id": order, "payment_id": pay, "entity_id": i, "settlement_utr": utr}.items() if v}
    return (i, org, "processor_recon", kind, amount, 5, dt.date(2025, 1, 1), "Acme", ids, {"settled_at": moment} if moment else {}, BASE + dt.timedelta(days=load), load, "clash")


ROWS = [
    move("a", 1),
    move("a", 3),  # delivered again: its load is the first
    move("b", 2, amount=1002, pay="DUP.pay_000001"),
    move("c", 3, order=None),
    move("same_load", 1),
    move("other_moment", 2, moment="2"),
    move("other_amount", 2, amount=1100),
    move("other_order", 2, order="ord_000009", pay="pay_000009"),
    move("other_tenant", 2, org="x"),
    move("no_moment1", 4, moment=None, pay="pay_000007", order="ord_000007"),
    move("no_moment2", 5, moment=None, pay="pay000007", order="ord_000007"),
    move(None, 2),
    move("zeros1", 6, moment="50", pay="pay_000345", order=None, amount=7000),
    move("zeros2", 7, moment="50", pay="345/2", order=None, amount=7001),
    move("lost_moment1", 6, moment="60", pay="pay_000600", order="ord_000600", amount=8000),
    move("lost_moment2", 7, moment=None, pay="pay_000600", order="ord_000600", amount=8000),
    move("order_only", 6, moment="1735700000", pay=None, order="ord_000700", amount=9000),
    move("pay_only", 7, moment="1735700000", pay="pay_000701", order=None, amount=9000),
    move("bare1", 6, moment=None, pay=None, order=None, utr=None, amount=500),
    move("bare2", 7, moment=None, pay=None, order=None, utr=None, amount=500),
    move("bare3", 7, moment=None, pay=None, order=None, utr=None, amount=501),
]
SAME = {("a", "b"), ("a", "c"), ("b", "c"), ("b", "same_load"), ("c", "same_load"), ("no_moment1", "no_moment2")}
SAME |= {("zeros1", "zeros2"), ("lost_moment1", "lost_moment2"), ("order_only", "pay_only"), ("bare1", "bare2")}


def test_repeats(spark):
    df = spark.createDataFrame(ROWS, MOVE)
    for step in (1, 3, 99):
        got = [(r["record_a"], r["record_b"]) for r in history.all_repeats(df, step).collect()]
        assert len(got) == len(set(got)) and set(got) == SAME
    assert history.all_repeats(df.limit(0)).count() == 0


def test_each_new_load_against_the_store(spark, tmp_path):
    df = spark.createDataFrame([r for r in ROWS if r[0]], MOVE)
    got = set()
    for load in range(1, 8):
        # Opened anew each time, as a later job would.
        store = history.AcceptedHashes(spark, str(tmp_path / "hashes"), buckets=3)
        new = history.movement_hashes(df.where(f"ingest_batch = {load}"))
        got |= {tuple(sorted((r["new_id"], r["old_id"]))) for r in store.check_and_append(new).collect()}
        assert store.check_and_append(new).count() == 0  # the same load again
        assert spark.table(store.paragraphs).count() == spark.table(store.paragraphs).select("id").distinct().count()
        store.close()
    assert got == SAME


def test_a_load_reads_its_months_bucket_by_bucket(spark, tmp_path):
    store = history.AcceptedHashes(spark, str(tmp_path / "hashes"))
    new = history.movement_hashes(spark.createDataFrame([move("x", 1, moment="1735700000")], MOVE))
    store.check_and_append(new)
    plan = store.check(new, ["202501"])._jdf.queryExecution().toString()
    assert "month#" in plan and "PartitionFilters: [month#" in plan and "Bucketed: true" in plan
    store.close()


def test_one_moment_of_very_many_movements(spark):
    rows = [move(f"h{i}", i % 5, moment="77", order=f"ord_{i:06}", pay=f"pay_{i:06}") for i in range(1000, 4000)]
    rows += [move("h_copy", 9, moment="77", order="ord_001234", pay=None)]
    h = history.movement_hashes(spark.createDataFrame(rows, MOVE))
    a, b = history._keys(h, True), history._keys(h, False)
    assert a.join(b.select("key"), "key").count() < 30 * len(rows)
    assert {(r["record_a"], r["record_b"]) for r in history.all_repeats(spark.createDataFrame(rows, MOVE)).collect()} == {("h1234", "h_copy")}


# -- names -----------------------------------------------------------------------------------------------------------
def test_slips():
    assert [names.slips("ABCD", x) for x in ("ABCD", "ABDC", "ABC", "AXCD", "BADC", "WXYZ")] == [0, 1, 1, 1, 2, 3]


def grouped(spark, spellings):
    df = spark.createDataFrame([(x, i, "clash") for i, x in enumerate(spellings)], "counterparty string, n int, spelling string")
    by = {}
    for r in names.resolve(df).collect():
        by.setdefault(r["party"], set()).add(r["spelling"])
    return sorted(map(sorted, by.values()))


def test_few_spellings(spark):
    """Tables too small to learn from: usual short forms, other endings, initials, slips; nothing joins on a surname alone."""
    parties = [
        ["Mohammed S Mipozunuzir", "MOHD MIPOZUNUZIR", "Mipozunuzir, Mohammed", "mohd. s mipozunzuir", "Mohámmed Mipozunuzir "],
        ["Katherine Mipozunuzir", "KATE MIPOZUNUZIR"],
        ["Anthony Zubomidilir", "Tony Zubomidilir", "ZUBOMIDILIR, TONY"],
        ["Zubomidilir Bakery", "Zubomidilir Bakeries Ltd"],
        ["Michael Fitorunozas", "Mike Fitorunozas", "Fitorunozas Mick"],
        ["Zadok Lumakidero", "LUMAKIDERO, Z.", "Lumakidero Zadok"],
        ["Perin Gotavulise"], ["Osla Gotavulise"], ["Gotavulise"],
        [""], ["Q" * 5000],
    ]
    flat = [s for p in parties for s in p]
    assert grouped(spark, [*flat, *flat, None]) == sorted(map(sorted, parties))
    df = spark.createDataFrame([(x,) for x in flat], "counterparty string")
    got = names.resolve(df)
    assert names.links(got).count() == sum(len(p) * (len(p) - 1) // 2 for p in parties)
    reps = names.representatives(got).collect()
    assert sum(r["spellings"] for r in reps) == len(flat) and len(reps) == len(parties)
    assert names.resolve(df.limit(0)).count() == 0


def test_vocabulary_is_learned(spark):
    """Invented trades and given names in no list: their forms are learned, and spellings of one party found."""
    rng = random.Random(21)
    syll = ["ba", "ke", "li", "mo", "ru", "sa", "te", "vo", "zu", "fi", "gu", "pa", "no", "di"]
    word = lambda n: "".join(rng.choice(syll) for _ in range(n))
    trades = [(word(4) + "ox", word(2) + "x") for _ in range(10)]
    given = [(word(3) + "h", word(2) + "y", word(2) + "wa") for _ in range(10)]
    typo = lambda w: (lambda k: w[:k] + w[k + 1] + w[k] + w[k + 2 :])(rng.randrange(1, len(w) - 2))
    mains, parties = set(), []
    while len(mains) < 420:
        mains.add(word(5) + rng.choice("nrls"))
    for i, m in enumerate(sorted(mains)):
        M = m.capitalize()
        if i % 2:
            full, short = rng.choice(trades)
            parties.append([f"{M} {full.title()} Ltd", f"{m.upper()} {short.upper()} LIMITED", f"M/s {M} {full}", f"{typo(m)} {full} pvt ltd", f"{short} {m}"])
        else:
            full, short, other = rng.choice(given)
            parties.append([f"{full.title()} {M}", f"{M}, {full.title()}", f"{short.upper()} {m.upper()}", f"mr {other} {m}", f"{full} {typo(m)}", f"{full[0].upper()}. {M}"])
        if i % 9 == 0:  # the same surname, another person
            x = rng.choice([g for g in given if i % 2 or g[0] != full])
            parties.append([f"{x[0].title()} {M}"])
    rows = [(s, i) for i, p in enumerate(parties) for s in p]
    df = spark.createDataFrame(rows, "counterparty string, i int")
    vocabulary = names.learn(df.select(F.col("counterparty").alias("spelling")).distinct(), known=[])
    for forms, role in [(t, "t") for t in trades] + [(g, "g") for g in given]:
        assert len({vocabulary.words[w.upper()] for w in forms}) == 1 and vocabulary.words[forms[0].upper()][0] == role
    of = {s: i for s, i in rows}
    found = {(r["spelling_a"], r["spelling_b"]) for r in names.links(names.resolve(df, known=[])).collect()}
    true = {tuple(sorted((a, b))) for p in parties for a in p for b in p if a < b}
    assert len(found & true) >= 0.98 * len(true)
    assert sum(of[a] != of[b] for a, b in found) <= 0.01 * len(found)


# -- leaks -----------------------------------------------------------------------------------------------------------
def brute_tile(a, b, least):
    ua, ub, out = set(), set(), []
    while True:
        best = []
        top = least
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                if n > top:
                    best, top = [(i, j)], n
                elif n == top:
                    best.append((i, j))
        if not best:
            return sum(out)
        for i, j in best:
            if not (set(range(i, i + top)) & ua or set(range(j, j + top)) & ub):
                ua |= set(range(i, i + top))
                ub |= set(range(j, j + top))
                out.append(top)


def test_tiling_covers_as_much_as_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        tiles = leaks.tile(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)
        assert len({x for i, _, n in tiles for x in range(i, i + n)}) == sum(n for *_, n in tiles)
        assert abs(sum(n for *_, n in tiles) - brute_tile(a, b, leaks.TILE)) <= max(3, 0.25 * len(a))


ITEM = " ".join(f"word{i} says amount {i * 37} and" for i in range(8))


def test_leaks(spark):
    w = ITEM.split()
    near = list(w)
    near[7], near[12] = "wrod", "othr"
    docs = [
        (1, "intro " + ITEM.upper().replace(" ", "\n") + " outro", 0),
        (2, "x " + " ".join(w[5:27]) + " y", 0),
        (3, "a few " + " ".join(w[5:13]) + " words", 0),
        (4, "z " + "<br>".join(" ".join(near[k : k + 5]) for k in range(0, 30, 5)) + " z", 0),
        (5, " ".join(f"word{i} says amount {i * 37 + 5} and" for i in range(8)), 0),
        (6, " ".join(w[20:] + w[:20]), 0),
        (7, None, 0),
        (8, "", 0),
        (9, "filler " * 50_000 + ITEM, 0),
        (10, " and then ".join(" ".join(w[k : k + 4]) for k in range(len(w) - 4, -1, -4)), 0),
        (11, " x ".join(" ".join(w[k : k + 3]) for k in range(len(w) - 3, -1, -3)), 0),
        (12, "ＷＯＲＤ０ " + " ".join(w[1:]).replace("says", "sàys").replace("and", "and,"), 0),
        (1, "again under the same id", 0),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, 5), (1, ITEM, 5), (2, None, 5), (3, "short one", 5)], "item_id bigint, text string, doc_id int")
    for bound in (10, 1_000_000):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, items, bound).collect()}
        assert got == {(1, 1), (2, 1), (4, 1), (6, 1), (9, 1), (10, 1), (11, 1), (12, 1)}
    assert leaks.find_leaks(d, items.limit(0)).count() == leaks.find_leaks(d.limit(0), items).count() == 0


def test_no_leak_is_lost_before_tiling(spark):
    """All pairs tiled by themselves against what the seed join lets through."""
    rng = random.Random(12)
    items = [[f"t{rng.randrange(300)}" if rng.random() < 0.9 else str(rng.randrange(9)) for _ in range(rng.choice([5, 12, 20, 25, 40]))] for _ in range(12)]
    docs = []
    for _ in range(120):
        w = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        part = list(rng.choice(items))
        size = rng.choice([1, 2, 3, 4, 5, 8, 20])
        pieces = [part[k : k + size] for k in range(0, len(part), size)]
        rng.shuffle(pieces) if rng.random() < 0.5 else None
        part = [x if rng.random() > 0.05 else "zz" for p in pieces for x in p]
        docs.append(w[:20] + part[: rng.randrange(3, len(part) + 1)] + w[20:])
    want = set()
    for i, doc in enumerate(docs):
        for k, item in enumerate(items):
            ids = {x: n for n, x in enumerate({*doc, *item})}
            tiles = leaks.tile([ids[x] for x in doc], [ids[x] for x in item])
            span, got = leaks.best_passage(tiles, [any(c.isdigit() for c in x) for x in item])
            if leaks.is_leak(span, got, sum(n for *_, n in tiles), len(item)):
                want.add((i, k))
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string")
    e = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    assert 10 < len(want) and {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, e).collect()} == want


# -- mixing ----------------------------------------------------------------------------------------------------------
def test_sainte_lague_against_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        w = {k: rng.uniform(0.01, 1) for k in "abcde"}
        caps = {k: rng.randrange(0, 60) for k in "abc"}
        seats = rng.randrange(0, 120)
        plain = dict.fromkeys(w, 0)
        for _ in range(seats):
            free = [k for k in w if plain[k] < caps.get(k, seats)]
            if not free:
                break
            best = max(free, key=lambda k: (w[k] / (2 * plain[k] + 1), [-ord(c) for c in k]))
            plain[best] += 1
        assert mixing.sainte_lague(w, seats, caps) == plain


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, "big" if i % 4 else "small", rng.randrange(50, 200)) for i in range(800)] + [(900, None, 5), (901, "none", 5), (902, "big", None), (1, "big", 77)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("void", 0.0, None)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, block=64)
    got = {r["source"]: r for r in mixing.shares(m, d, t).collect()}
    assert abs(got["small"]["reached_share"] - 0.5) < 0.02 and got["small"]["most_repeats"] <= 3 and got["big"]["most_repeats"] == 1
    assert m.where("doc_id in (900, 901, 902)").count() == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.mix(d, t, block=64).collect()))
    assert mixing.mix(d.limit(0), t).count() == 0


def test_blocks_are_a_permutation():
    for n in (1, 2, 3, 16, 97, 1000):
        step, start = mixing.permutation(n, f"s{n}")
        assert sorted((k * step + start) % n for k in range(n)) == list(range(n))


def test_quotas_in_blocks(spark):
    """Every source gets its apportioned blocks, whichever way its documents fall; equal documents show it exactly."""
    docs = [(i, s, 64) for s, n in (("a", 1600), ("b", 400), ("c", 200)) for i in range(n) for i in [i + {"a": 0, "b": 10_000, "c": 20_000}[s]]]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 4), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    total = sum(n for *_, n in docs)
    caps = {"a": 1600, "b": 1600, "c": 400}
    quota = mixing.sainte_lague({"a": 0.3, "b": 0.4, "c": 0.3}, total // 64, caps)
    m = mixing.mix(d, t, block=64, shards=4)
    got = {r["source"]: (r["tokens_used"], r["most_repeats"]) for r in mixing.shares(m, d, t).collect()}
    assert {s: n for s, (n, _) in got.items()} == {s: q * 64 for s, q in quota.items()}
    assert all(r <= {"a": 1, "b": 4, "c": 2}[s] for s, (_, r) in got.items())
    other = mixing.mix(d, t, seed=18, block=64, shards=4)
    assert m.subtract(other).count() > 0  # another seed chooses other blocks


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 60_000), (5, "<|endoftext|>")], "doc_id int, text string")
    n = {r["doc_id"]: r["tokens"] for r in mixing.with_tokens(d).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and 59_000 < n[4] < 122_000 and n[5] > 1


# -- abuse -----------------------------------------------------------------------------------------------------------
def test_abuse_held_out(spark):
    plain = ["the payment of order 12 was booked on friday", "please check the fee on the last invoice", "we await the missing credit within five days", "the export of june had seven repeated lines", "our team moved the item to the next period"]
    rude = ["you are a useless lying idiot", "shut your mouth you stupid clown", "drop dead you worthless scum"]
    rng = random.Random(8)

    def doc(bad):
        s = rng.sample(plain, 4)
        if bad:
            x = rng.choice(rude)
            s.insert(rng.randrange(5), x.replace("i", "*", 1) if rng.random() < 0.3 else x)
        return ". ".join(s)

    y = [rng.random() < 0.3 for _ in range(300)]
    model = abuse.train([doc(b) for b in y], y)
    test_y = [rng.random() < 0.3 for _ in range(200)]
    s = model.scores([doc(b) for b in test_y])
    assert np.mean((s > 0.5) == np.asarray(test_y)) > 0.95
    assert list(model.scores([None, "", "  "])) == [0, 0, 0]
    assert abuse.normal("You S T U P I D  miiiierda") == " you stupid mierda "
    d = spark.createDataFrame([(1, "x " * 60_000 + rude[0], "s"), (2, None, None), (3, plain[0], "s")], "doc_id int, text string, source string")
    got = {r["doc_id"]: r["flagged"] for r in abuse.score_documents(d, model).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert {(r["source"], r["documents"], r["flagged"]) for r in abuse.rates(abuse.score_documents(d, model)).collect()} == {("s", 2, 1), (None, 1, 0)}


def test_abuse_survives_wrong_labels_and_masks():
    """A tenth of the sober documents is labelled abusive, and insults are masked at random."""
    rng = random.Random(9)
    nouns = ["payment", "refund", "invoice", "credit", "export", "ledger", "notice", "advice", "batch", "charge"]
    verbs = ["was booked on", "went missing in", "was split over", "came twice with", "differs from", "closed without"]
    sober = lambda k: f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} of {k} and {rng.choice(nouns)}s"
    rude = ["you are a useless lying idiot", "shut your mouth you stupid clown", "drop dead you worthless scum", "get lost you filthy parasite"]

    def doc(bad, place, mask):
        s = [sober(place) for _ in range(5)]
        if bad:
            x = rng.choice(rude)
            k = rng.randrange(len(x) - 1)
            s.insert(rng.randrange(6), x[:k] + mask + x[k + 1 :] if rng.random() < 0.4 and x[k] != " " else x)
        return ". ".join(s)

    truth = [rng.random() < 0.25 for _ in range(500)]
    told = [y or rng.random() < 0.1 for y in truth]
    model = abuse.train([doc(y, "june", "*") for y in truth], told)
    test = [rng.random() < 0.25 for _ in range(300)]
    s = model.scores([doc(y, "june", "*") for y in test])
    assert np.mean((s > 0.5) == np.asarray(test)) > 0.96
    assert abuse.normal("you 54l4ud put4 12345 ord_0999") == " you salaud puta 0 0 "


def test_model_is_fitted_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "you are a useless lying idiot" if i % 2 else f"the payment {i} was booked on friday") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, "abusive" if i % 2 else "none") for i in range(60)], "doc_id bigint, annotator int, category string")
    first = abuse.fit_model(docs, labels)
    monkeypatch.setattr(abuse, "train", lambda *a: pytest.fail("fitted again"))
    again = abuse.fit_model(docs, labels)
    assert (again.weights == first.weights).all() and (again.bias, again.threshold) == (first.bias, first.threshold)


def test_abuse_without_labels():
    assert abuse.train(["a b c"], [False]).scores(["a b c"]).max() < 1e-9
    assert abuse.train([], []).scores(["x"]).max() < 1e-9
