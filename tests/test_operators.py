"""Small fixtures against brute force: late records, references, greedy, pools, rules, formats, events."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money, refs
from ledgerloom.operators import events as E
from ledgerloom.operators import exceptions as X
from ledgerloom.operators import fs
from ledgerloom.operators import learning as L
from ledgerloom.operators import matching as M
from ledgerloom.operators import memory as Y
from ledgerloom.operators import references as R
from ledgerloom.operators.normalize import normalize
from ledgerloom.operators.rules import Rule, RuleError, compile_rule, first_match
from ledgerloom.sources import bank_formats as B
from ledgerloom.streaming import late

RECORD = "id string, org_id string, source string, kind string, amount_minor bigint, fee_minor bigint, tax_minor bigint, value_date date, settled_at date, ingested_at timestamp, ingest_batch int, period string, external_ids map<string,string>"


def ts(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2025, 2, 1, tzinfo=dt.UTC) + dt.timedelta(days=day - 1, hours=hour)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def rec(i, at, value=dt.date(2025, 1, 5), settled=None, org="o", amount=100):
    return (i, org, "bank", "credit", amount, 0, 0, value, settled, at, 1, "clash", {})


@pytest.fixture(scope="module")
def close(spark):
    return spark.createDataFrame([("o", "bank", "2025-01", ts(1), ts(10)), ("o", "bank", "2025-01", ts(1), ts(9))], "org_id string, source string, period string, ends_at timestamp, cutoff_at timestamp")


def test_lateness(spark, close):
    rows = [
        rec("on", ts(0)),
        rec("corr", ts(5)),
        rec("late", ts(11)),
        rec("again", ts(12)),
        rec("again", ts(2)),  # delivered again out of order: the first arrival counts
        rec("undated", ts(11), None, None),
        rec("bysettled", ts(20), None, dt.date(2025, 1, 31)),
        rec("open", ts(20), dt.date(2025, 3, 1)),
        rec(None, ts(20)),
        rec("noarrival", None),
        rec("nullamount", ts(0), amount=None),
    ]
    got = {r["id"]: r["timing"] for r in late.with_lateness(records(spark, rows), close).collect()}
    assert got == {"on": "on_time", "corr": "correction", "late": "too_late", "again": "correction", "undated": "undated", "bysettled": "too_late", "open": "open", "nullamount": "on_time"}
    s = late.period_sums(late.with_lateness(records(spark, rows), close)).where("period = '2025-01'").first()
    assert (s["n_first_closed"], s["n_corrected"], s["n_too_late"], s["sum_corrected"]) == (2, 4, 2, 300)
    assert late.with_lateness(records(spark, []), close).count() == 0


def streamed(spark, close, tmp_path, parts, disorder=late.DISORDER):
    """The stream over ``parts``, one file and micro-batch each; (base, progress)."""
    import os

    for k, part in enumerate(parts):
        records(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)  # taken in this order
    stream = spark.readStream.schema(records(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    base = str(tmp_path / "state")
    return base, late.run_event_windows(stream, close, base, disorder)


def same_as_batch(spark, close, base, rows):
    timed = late.with_lateness(records(spark, rows), close)
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*late.KEYS, *late.SUMS, "n_too_late", "sum_too_late").collect())
    assert key(late.aggregates(spark, base)) == key(late.period_sums(timed))
    assert {r["id"] for r in late.diverted(spark, base).collect()} == {r["id"] for r in late.too_late(timed).collect()}


def test_stream_equals_batch_out_of_order(spark, close, tmp_path):
    rng = random.Random(3)
    rows = [rec(f"r{rng.randrange(60)}", ts(rng.randrange(-3, 20)), amount=7) for _ in range(160)]
    rows += [rec("open", ts(3), dt.date(2025, 3, 1)), rec("undated", ts(3), None, None), rec(None, ts(3)), rec("null", ts(2), amount=None), rec("x", ts(2), org=None), rec("x", ts(1), org=None)]
    base, progress = streamed(spark, close, tmp_path, [rows[k::4] for k in range(4)])
    same_as_batch(spark, close, base, rows)
    changes = spark.read.parquet(f"{base}/changes")
    assert changes.where("sign = -1").count() > 0 and changes.select("batch").distinct().count() > 1


def test_micro_batches_go_by_bytes_and_state_partitions(spark, sf, tmp_path, monkeypatch):
    import os

    from ledgerloom.queries import integrity as I

    rows = spark.read.parquet(f"{sf}/recon_record.parquet")
    rows.repartition(24, "id").write.parquet(str(tmp_path / "recon_record.parquet"))
    os.symlink(f"{sf}/period_close.parquet", tmp_path / "period_close.parquet")
    want = {r["record_id"] for r in I.p3_too_late(spark, sf).selectExpr("id as record_id").collect()}
    batches = lambda base: len([f for f in os.listdir(f"{base.removeprefix('file:')}/state-arrivals/commits") if f.isdigit()])
    # Many small files are one micro-batch: its price is the state's partitions, not its files.
    base = I._streamed(spark, str(tmp_path))
    assert batches(base) <= 2
    assert {r["id"] for r in late.diverted(spark, base).collect()} == want
    monkeypatch.setattr(I, "LEAST_BYTES", 1)
    monkeypatch.setattr(I, "PARTITION_BYTES", sum(f.stat().st_size for f in (tmp_path / "recon_record.parquet").glob("*.parquet")) // 4 // 4)
    base = I._streamed(spark, str(tmp_path))
    assert 3 <= batches(base) <= 8
    assert {r["id"] for r in late.diverted(spark, base).collect()} == want


def launched(spark, folder, run):
    """Command lines of the processes that the JVM launches while ``run`` runs."""
    record = spark._jvm.jdk.jfr.Recording()
    record.enable("jdk.ProcessStart").withoutStackTrace()
    record.start()
    run()
    record.stop()
    at = spark._jvm.java.nio.file.Path.of(str(folder / "launched.jfr"), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
    record.dump(at)
    record.close()
    return [e.getString("command") for e in spark._jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(at)]


def test_state_on_local_files_is_kept_without_processes(spark, close, tmp_path):
    kept = {k: spark.conf.get(k, None) for k in late.LOCAL_FILES}
    parts = [[rec(f"a{i}", ts(i % 9)) for i in range(30)], [rec("b", ts(11)), rec("a1", ts(-1))]]
    commands = launched(spark, tmp_path, lambda: streamed(spark, close, tmp_path, parts))
    assert commands and not [c for c in commands if c.startswith("readlink")]
    # Of a state's change to a partition: the file and its checksum by Hadoop, no second pair of files.
    assert not [c for c in commands if ".delta.crc." in c] and [c for c in commands if ".delta." in c]
    assert {k: spark.conf.get(k, None) for k in late.LOCAL_FILES} == kept
    same_as_batch(spark, close, str(tmp_path / "state"), [r for p in parts for r in p])
    # A second run goes on from that state.
    records(spark, [rec("c", ts(12)), rec("d", ts(8))]).coalesce(1).write.parquet(str(tmp_path / "in2"))
    late.run_event_windows(spark.readStream.schema(records(spark, []).schema).parquet(str(tmp_path / "in*")), close, str(tmp_path / "state"))
    same_as_batch(spark, close, str(tmp_path / "state"), [*(r for p in parts for r in p), rec("c", ts(12)), rec("d", ts(8))])


def test_state_is_evicted_after_the_cutoff(spark, close, tmp_path):
    parts = [[rec(f"a{i}", ts(i % 9)) for i in range(30)], [rec(f"b{i}", ts(55), dt.date(2025, 3, 5)) for i in range(5)], [rec("c", ts(60), dt.date(2025, 3, 6)), rec("a1", ts(61)), rec("d", ts(61))], [rec("e", ts(62), dt.date(2025, 3, 6))]]
    base, progress = streamed(spark, close, tmp_path, parts)
    assert sum(p["evicted"] for p in progress) >= 31 and not any(p["dropped"] for p in progress)
    same_as_batch(spark, close, base, [r for p in parts for r in p])
    # "d" came after the state was gone and is diverted; "a1" had come in time and is no late record.
    assert [r["id"] for r in late.diverted(spark, base).collect()] == ["d"]


def test_more_disorder_than_allowed_is_an_error(spark, close, tmp_path):
    parts = [[rec("new", ts(80), dt.date(2025, 4, 1))], [rec("x", ts(81), dt.date(2025, 4, 1))], [rec("old", ts(5))]]
    with pytest.raises(late.OutOfOrderError):
        streamed(spark, close, tmp_path, parts)


def test_empty_stream(spark, close, tmp_path):
    base, _ = streamed(spark, close, tmp_path, [[], []])
    assert late.aggregates(spark, base).count() == late.diverted(spark, base).count() == 0


def test_orphans(spark):
    rows = [("p1", "o", "payment", " Pay_1 "), ("r1", "o", "refund", "PAY_1"), ("r2", "o", "refund", "pay_2"), ("r2", "o", "refund", "pay_2"), ("r3", "x", "refund", "pay_1"), ("r4", "o", "refund", " "), ("r5", "o", "refund", None), ("r6", None, "refund", "pay_1")]
    r = spark.createDataFrame(rows, "id string, org_id string, kind string, k string")
    long = R.parent_keys(r.where("kind = 'payment'"), F.col("org_id"), F.col("k"), "l").unionByName(R.child_keys(r.where("kind = 'refund'"), F.col("org_id"), F.col("k"), "l", "t", F.col("id"), F.lit("2025-01")))
    assert sorted((x["row_id"], x["missing_key"]) for x in R.orphans(long).collect()) == [("r2", "PAY_2"), ("r3", "PAY_1"), ("r6", "PAY_1")]
    assert R.orphans(long.limit(0)).count() == 0


def test_greedy_equals_sequential(spark):
    rng = random.Random(1)
    for _ in range(3):
        pairs = list({(rng.randrange(8), f"c{rng.randrange(8)}"): rng.randrange(4) for _ in range(25)}.items())
        rows = [(a, b, g) for (a, b), g in pairs]
        left, right, want = set(), set(), []
        for a, b, g in sorted(rows, key=lambda x: (x[2], x[1], x[0])):
            if a not in left and b not in right:
                left.add(a), right.add(b), want.append((a, b))
        df = spark.createDataFrame(rows, "batch_key int, credit_id string, gap int")
        got = [(r["batch_key"], r["credit_id"]) for r in M.greedy(df, ["gap"], "batch_key", "credit_id").collect()]
        assert sorted(got) == sorted(want)
    assert M.greedy(df.limit(0), ["gap"], "batch_key", "credit_id").count() == 0


def test_subsets():
    v = [("a", 100), ("b", 250), ("c", 700)]
    assert M.subset_sum(v, 950, 0) == ["b", "c"]
    assert M.subset_sum([("a", 5), ("b", 5)], 5, 0) is None  # ambiguous
    assert M.subset_sum(v, 5, 0) is None
    assert M.unique_sum(v, 350, 0, (2, 3)) == ["a", "b"]
    big = [(str(i), 1000 + i) for i in range(30)]
    assert M.subset_sum(big, 1029, 0) == ["29"]


def test_jaro_winkler():
    assert M.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert M.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert (M.jaro_winkler("", "A"), M.jaro_winkler(None, "A"), M.jaro_winkler("A", "A"), M.jaro_winkler("AB", "CD")) == (0.0, 0.0, 1.0, 0.0)


def test_rules(spark):
    df = spark.createDataFrame([(5, "x", None), (-7, "", 3), (None, None, 0)], "a int, b string, c int")
    run = lambda t: [r[0] for r in df.select(compile_rule(t, set(df.columns))).collect()]
    assert run("a > 0 and b == 'x'") == [True, False, False]
    assert run("c == None or is_empty(b)") == [True, True, True]
    assert run("-10 < a <= 5") == [True, True, False]
    assert run("a % 4 == 1") == [True, True, False]  # the divisor's sign
    assert run("a // 2 == -4") == [False, True, False]
    assert run("a / c > 0") == [False, False, False]
    assert run("a in (5, 6) or not (c != 3)") == [True, True, False]
    for bad in ("__import__('os')", "a.__class__", "(lambda: 1)()", "[x for x in (1,)]", "zz > 1", "a if a else b", "open('x')", "a >"):
        with pytest.raises(RuleError):
            compile_rule(bad, set(df.columns))
    kind, rid = first_match([Rule("broken", "zz > 1", "N"), Rule("one", "a > 0", "A"), Rule("two", "a > -100", "B")], set(df.columns))
    assert [(r[0], r[1]) for r in df.select(kind, rid).collect()] == [("A", "one"), ("B", "two"), (None, None)]


MT940 = ":20:X\n:25:HDFC0001234\n:60F:C240101INR0,\n:61:2401020102CR12345,67NTRF\n:86:NEFT CR UTR AXISN52024010145678\nACME LTD\n:61:2401030103D2000,00NCHG\n:86:CHARGES\n:61:GARBAGE\n:62F:C240103INR0,\n"
CAMT = """<?xml version="1.0"?><d:Document xmlns:d="urn:x"><d:BkToCstmrStmt><d:Stmt><d:Acct><d:Id><d:IBAN>IN00HDFC0001234</d:IBAN></d:Id></d:Acct>
<d:Ntry><d:Amt Ccy="INR">12345.67</d:Amt><d:CdtDbtInd>CRDT</d:CdtDbtInd><d:BookgDt><d:Dt>2024-01-02</d:Dt></d:BookgDt><d:ValDt><d:DtTm>2024-01-03T10:00:00</d:DtTm></d:ValDt><d:NtryDtls><d:TxDtls><d:Refs><d:EndToEndId>E2E</d:EndToEndId></d:Refs><d:RmtInf><d:Ustrd>UTR AXISN52024010145678</d:Ustrd></d:RmtInf></d:TxDtls></d:NtryDtls></d:Ntry>
<d:Ntry><d:Amt Ccy="INR">2000.00</d:Amt><d:CdtDbtInd>DBIT</d:CdtDbtInd><d:BookgDt><d:Dt>2024-01-04</d:Dt></d:BookgDt><d:AcctSvcrRef>SVC</d:AcctSvcrRef></d:Ntry></d:Stmt></d:BkToCstmrStmt></d:Document>"""
PDF = "Statement of account\n02/01/2024 NEFT ACME UTR AXISN52024010145678 12,345.67 CR 99,999.00\n03/01/2024 CHARGES 2,000.00 DR 97,999.00\nPage 1\n"


def test_bank_formats(spark, tmp_path):
    for name, text in (("a.sta", MT940), ("b.xml", CAMT), ("c.txt", PDF)):
        (tmp_path / name).write_text(text)
    m = B.read_statement(spark, str(tmp_path / "a.sta")).orderBy("row_no").collect()
    assert [r["amount"] for r in m] == ["12345.67", "-2000.00", None]
    assert (m[0]["utr"], m[0]["account_no"], m[0]["value_date"], m[0]["posted_date"]) == ("AXISN52024010145678", "HDFC0001234", "2024-01-02", "2024-01-02")
    assert "ACME LTD" in m[0]["narration"]
    c = B.read_statement(spark, str(tmp_path / "b.xml")).orderBy("row_no").collect()
    assert [(r["amount"], r["value_date"], r["posted_date"], r["account_no"]) for r in c] == [("12345.67", "2024-01-03", "2024-01-02", "IN00HDFC0001234"), ("-2000.00", None, "2024-01-04", "IN00HDFC0001234")]
    assert c[1]["narration"] == "SVC"
    p = B.read_statement(spark, str(tmp_path / "c.txt")).orderBy("row_no").collect()
    assert [r["amount"] for r in p] == ["12345.67", "-2000.00"]
    with pytest.raises(ValueError):
        B.read_statement(spark, "x.bin")


def test_csv_files(spark, tmp_path):
    from ledgerloom.sources.csv_files import read_csv_rows, sniff_header

    assert sniff_header(["Report of May", "order_id;order_total;order_date"], ["order_id", "order_total"])[0] == 1
    (tmp_path / "l.csv").write_text("Ledger export,,\norder_id,order_total,order_date\no1,10.50,2025-01-02\no2,x,2025-01-02\nTotal,10.50,\n")
    fx = spark.createDataFrame([("INR", 1.0)], "currency string, rate_to_inr double")
    got = read_csv_rows(spark, str(tmp_path / "l.csv"), "ledger", ["order_id", "order_total", "order_date"], fx).collect()
    assert sorted((r["raw"], r["status"], r["reason"]) for r in got) == [("Total,10.50,", "skipped", None), ("o1,10.50,2025-01-02", "loaded", None), ("o2,x,2025-01-02", "failed", "value")]


def test_normalize(spark):
    cells = [
        {"amount": "100.00", "value_date": "2025-01-02", "currency": "USD", "narration": "pay 4111 1111 1111 1111 UTR ABCD0123456789"},
        {"amount": "", "debit": "5.00", "value_date": "02/01/2025"},
        {"amount": "1.00", "value_date": "2025-01-02", "currency": "JPY"},
        {"amount": "1.00"},
        {"amount": "1.00", "value_date": "1999-01-01"},
        {"value_date": "2025-01-02"},
    ]
    df = spark.createDataFrame([(i, "f", i, c) for i, c in enumerate(cells)], "line_id bigint, file_hash string, line_no int, cells map<string,string>")
    files = spark.createDataFrame([("f", "bank", "o")], "file_hash string, source string, org_id string")
    fx = spark.createDataFrame([("INR", 1.0), ("USD", 83.2)], "currency string, rate_to_inr double")
    got = normalize(df, files, fx, "run").orderBy("line_id").collect()
    assert [r["error"] for r in got] == [None, None, "no rate for JPY", "no date", "implausible date", "missing amount"]
    assert (got[0]["amount_minor"], got[0]["external_ids"]["fx_orig_amount_minor"], got[0]["external_ids"]["utr"], got[0]["card_found"]) == (832000, "10000", "ABCD0123456789", True)
    assert got[0]["untrusted"]["narration"].startswith("pay [card ****1111]")
    assert (got[1]["amount_minor"], got[1]["kind"]) == (-500, "credit")


def test_text_and_money(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111 ok",), ("4111111111111112",), (None,)], "t string")
    assert [r[0] for r in df.select(refs.scrub_cards("t")).collect()] == ["[card ****1111]ok", "4111111111111112", None]
    m = spark.createDataFrame([(123456789,), (-5,), (99900,), (None,)], "m bigint")
    assert [r[0] for r in m.select(money.format_minor("m")).collect()] == ["₹12,34,567.89", "-₹0.05", "₹999.00", None]
    n = spark.createDataFrame([("NEFT CR Acme Pvt. Ltd. & Sons", "ACME SONS"), ("Acme", "Other"), ("", None)], "a string, b string")
    assert [r[0] for r in n.select(refs.same_entity("a", "b")).collect()] == [True, False, False]


def test_fellegi_sunter(spark):
    assert fs.bits(0.9, 0.001) == pytest.approx(9.813781, abs=1e-6)
    df = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "p double")
    assert [r[0] for r in df.select(fs.calibrated(F.col("p"), [(0.5, 0.6), (0.1, 0.2)])).collect()] == pytest.approx([0.2, 0.35, 0.6])
    assert [r[0] for r in df.select(fs.calibrated(F.col("p"), [])).collect()] == [0.0, 0.25, 1.0]


def test_learning(spark):
    assert L.isotonic([(0.1, 0.5), (0.2, 0.3), (0.3, 0.9)]) == [(0.1, 0.4), (0.3, 0.9)]
    rng = random.Random(5)
    rows = [(rng.randrange(5) / 5, rng.random() < 0.5) for _ in range(60)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, y boolean")
    assert L.auc(df, "s", "y").first()["auc"] == pytest.approx(want, abs=1e-5)
    right = {c: sum((s >= c) == y for s, y in rows) for c in {round(s, 3) for s, _ in rows}}
    best = L.best_threshold(df, "s", "y", 0.0, 1.0).first()
    assert best["right"] == max(right.values()) and best["threshold"] == min(c for c, n in right.items() if n == max(right.values()))


def test_memory_against_brute_force(spark):
    import math

    docs = {1: "a b b c", 2: "a b d", 3: "x y", 4: "a c c", 5: ""}
    bag = [(d, t, float(txt.split().count(t))) for d, txt in docs.items() for t in set(txt.split())]
    df = spark.createDataFrame(bag, "doc int, token string, w double")
    dfreq = {t: sum(t in x.split() for x in docs.values()) for t in {b[1] for b in bag}}
    vec = {d: {t: w * (math.log(5 / (dfreq[t] + 1)) + 1) for d2, t, w in bag if d2 == d} for d in (1, 2, 3, 4)}
    cos = lambda u, v: sum(u[t] * v.get(t, 0) for t in u) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
    want = sorted(((round(cos(vec[1], vec[d]), 5), d) for d in (2, 3, 4)), reverse=True)
    got = Y.cosine_recall(df, df.where("doc = 1"), k=2, floor=0.0).orderBy("rank").collect()
    assert [(round(r["similarity"], 5), r["doc"]) for r in got] == want[:2]


def _shuffled(spark) -> dict[int, int]:
    """Rows written to shuffles, by stage."""
    jvm = spark.sparkContext._jvm
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_recall_shuffles_no_pairs_of_documents(spark, monkeypatch):
    import math

    pick = random.Random(7)
    docs = {d: {"all": 1.0} | {f"t{int(40 * pick.random() ** 2)}": float(pick.randint(1, 3)) for _ in range(7)} | ({f"x{d // 9}": 1.0} if d % 3 else {}) for d in range(600)}
    df = spark.createDataFrame([(d, t, w) for d, bag in docs.items() for t, w in bag.items()], "doc int, token string, w double")
    before = _shuffled(spark)
    monkeypatch.setattr(Y, "BLOCK_ENTRIES", 1000)
    monkeypatch.setattr(Y, "FREQUENT", 20, raising=False)
    got = {(r["query"], r["rank"]): (r["doc"], r["similarity"]) for r in Y.cosine_recall(df, df.where("doc % 2 = 0")).collect()}
    # 300 queries share a token with every document: 180 000 pairs.
    assert sum(n for k, n in _shuffled(spark).items() if k not in before) < 10 * sum(map(len, docs.values()))
    count = {t: sum(t in bag for bag in docs.values()) for bag in docs.values() for t in bag}
    x = {d: {t: w * (math.log(601 / (count[t] + 1)) + 1) for t, w in bag.items()} for d, bag in docs.items()}
    norm = {d: math.sqrt(sum(v * v for v in bag.values())) for d, bag in x.items()}
    want = {}
    for q in range(0, 600, 2):
        near = [(-round(sum(v * x[d].get(t, 0.0) for t, v in x[q].items()) / norm[q] / norm[d], 6), d) for d in docs if d != q]
        want |= {(q, r): (d, -s) for r, (s, d) in enumerate(sorted(n for n in near if n[0] <= -0.15)[:3], 1)}
    assert got == want


def test_recall_by_chunks_is_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    bags = [sorted({f"t{int(60 * v**2)}" for v in rng.random(6)}) for _ in range(400)]
    norms = [float(np.sqrt(len(b))) for b in bags]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(bags), pa.array([[1.0] * len(b) for b in bags]), pa.array(norms)], names=["doc", "tokens", "weights", "norm"])
    rows = [(d, t, 1 / norms[d], 1.0) for d in range(0, 400, 4) for t in bags[d]]
    block = pa.table([pa.array([r[i] for r in rows]) for i in range(4)], names=["query", "token", "x", "idf"])
    want = set()
    for q in range(0, 400, 4):
        near = sorted((-np.round(len({*bags[q]} & {*bags[d]}) / norms[q] / norms[d], 6), d) for d in range(400) if d != q)
        want |= {(q, d, -s) for s, d in near[:3] if s <= -0.15}
    for cells in (700, 40_000):
        monkeypatch.setattr(Y, "CELLS", cells)
        out = [r for b in Y._best(block, "doc", 3, 0.15)([batch.slice(0, 90), batch.slice(90)]) for r in b.to_pylist()]
        assert {(r["query"], r["doc"], r["similarity"]) for r in out} == want


def test_chain_and_clusters(spark):
    ev = spark.createDataFrame([("r", i, "k", f"p{i}") for i in range(5)] + [("s", 1, "k", "p")], "run string, n int, kind string, payload string")
    c = E.chain(ev, "run", ["n"], "kind", "payload")
    assert {r["run"]: (r["events"], r["ok"]) for r in E.verify(c, "run").collect()} == {"r": (5, True), "s": (1, True)}
    bad = c.withColumn("payload", F.when((F.col("run") == "r") & (F.col("seq") == 2), "zz").otherwise(F.col("payload")))
    assert {r["run"]: r["first_break"] for r in E.verify(bad, "run").collect()} == {"r": 2, "s": None}
    x = spark.createDataFrame([("e1", "A", "rule:q", 5), ("e2", "A", "rule:q", 7), ("e3", "A", None, -7)], "exception_id string, category string, classified_by string, impact bigint")
    got = {(r["rule_id"], r["direction"]): (r["count"], r["gross_impact"], r["example_id"]) for r in X.clusters(x).collect()}
    assert got == {("q", "over"): (2, 12, "e2"), ("unclassified", "short"): (1, 7, "e3")}


def test_evidence_and_generated_data(spark):
    from ledgerloom.operators import evidence as V
    from ledgerloom.operators import generate as G

    lib = spark.createDataFrame([("s", "C", "b", "x", "t1"), ("s", "C", "b", "y", "t1"), ("s", "C", "b", "y", "t2"), ("q", "C", "b", "x", "t3"), ("q", "C", "b", "x", "t4")], "shape_key string, category string, band string, action string, contributor string")
    cases = spark.createDataFrame([(1, "s", "C", "b"), (2, "none", "C", "b"), (3, "none", "Z", "b")], "case_id int, shape_key string, category string, band string")
    assert {r["case_id"]: (r["found_by"], r["action"], r["occurrences"]) for r in V.recall_patterns(cases, lib).collect()} == {1: ("shape", "y", 2), 2: ("category", "x", 3), 3: (None, None, None)}
    o = G.orders(spark, 500)
    lines = G.processor_lines(o)
    assert o.count() == 500 and lines.where("kind = 'payment'").count() == 500 and 5 < lines.where("kind = 'refund'").count() < 60
    assert lines.where("dayofweek(settled_at) in (1, 7)").count() == 0
    again = G.processor_lines(G.orders(spark, 500, partitions=3))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, again.collect()))
    assert G.bank_credits(lines).agg(F.sum("amount")).first() == lines.agg(F.sum(F.col("amount") - F.col("fee") - F.col("tax"))).first()
    m = spark.createDataFrame([(i, f"l{i}", f"r{i}") for i in range(200)], "k int, l string, r string")
    got = V.shifted_pairs(m, "k", "l", "r")
    assert got.where("is_match").count() == 200 and got.where("not is_match and substring(l, 2) = substring(r, 2)").count() == 0
