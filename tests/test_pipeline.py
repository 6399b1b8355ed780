"""The load pipeline on small files: what is loaded is kept, refused with a reason, or a true repeat."""

from __future__ import annotations

import pytest

from ledgerloom.plans import pipeline
from ledgerloom.sources import quarantine as Q
from ledgerloom.tables import table

LEDGER, BANK, RECON = "order_id,order_total,order_date", "value_date,narration,amount", "entity_id,type,amount,settled_at,settlement_utr"
HEADERS = {"ledger": LEDGER, "bank": BANK, "processor_recon": RECON}
FILES = {
    "l1": ("o1", "ledger", LEDGER, ["a1,10.00,2025-01-02", "a2,20.00,2025-01-02", "a2,20.00,2025-01-02", "a3,1.00,1999-01-01"]),
    "l2": ("o1", "ledger", LEDGER, ["b1,30.00,2025-01-02", "a1,10.00,2025-01-02"]),  # its second row was delivered before
    "l3": ("o2", "ledger", LEDGER, ["a1,10.00,2025-01-02", "c2,20.00,2025-01-02"]),  # another tenant's equal row is its own
    "b1": ("o1", "bank", BANK, ["2025-01-02,x,5.00", "2025-01-02,y,5.00"]),
    "b2": ("o2", "bank", BANK, ["2025-01-02,x,5.00", "2025-01-03,x,5.00"]),
    "p1": ("o1", "processor_recon", RECON, ["pay_1,payment,500,2025-01-02,U1", "pay_1,payment,500,2025-01-02,U1", "pay_1,payment,700,2025-01-02,U1"]),
    "p2": ("o2", "processor_recon", RECON, ["pay_1,payment,500,2025-01-02,U1"]),
}


def test_loaded_is_records_quarantined_and_repeats(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(h, o, s, c) for h, (o, s, c, _) in FILES.items()], "file_hash string, org_id string, source string, header string").write.parquet(f"{d}/source_file.parquet")
    lines = [(h, n, line) for h, f in FILES.items() for n, line in enumerate(f[3], 1)]
    spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "line_id bigint, file_hash string, line_no int, line string").write.parquet(f"{d}/raw_line.parquet")
    spark.createDataFrame([("INR", 1.0)], "currency string, rate_to_inr double").write.parquet(f"{d}/fx_rate.parquet")
    loaded = Q.loaded(Q.classify_rows(table(spark, d, "raw_line"), table(spark, d, "source_file"), table(spark, d, "fx_rate"))).count()
    run = pipeline.run(spark, d)
    records = run.records.collect()
    want = {(FILES[h][0], FILES[h][1], line) for h, _, line in lines} - {("o1", "ledger", "a3,1.00,1999-01-01")}
    repeats = len(lines) - 1 - len(want)
    assert (loaded, repeats) == (len(lines) - 1, 3)
    assert run.quarantined.count() == 1
    assert len(records) == len(want) == loaded - repeats
    assert len({r["id"] for r in records}) == len(records)
    assert {(r["org_id"], r["source"], ",".join(r["raw"][c] for c in HEADERS[r["source"]].split(","))) for r in records} == want
    assert {(r["org_id"], r["lines"], r["expected_minor"]) for r in run.batches.collect()} == {("o1", 2, 1200), ("o2", 1, 500)}


def test_a_broken_run_goes_on_after_its_last_stage(spark, sf, tmp_path, monkeypatch):
    base = str(tmp_path / "run")
    first = pipeline.run(spark, sf, base=base)
    want = sorted(r["id"] for r in first.records.select("id").collect())
    monkeypatch.setattr(pipeline.Q, "BlockReader", lambda *a: pytest.fail("read again"))
    again = pipeline.run(spark, sf, base=base)
    assert sorted(r["id"] for r in again.records.select("id").collect()) == want


def test_payloads(spark):
    from ledgerloom.operators import events as E

    rows = [("a", '{"n": 1, "t": "x"}'), ("a", '{"n": "one", "t": "x"}'), ("a", '{"t": "x"}'), ("b", "{}"), ("c", "{}"), (None, "{}"), ("a", None), ("a", "{broken")]
    got = E.validated(spark.createDataFrame(rows, "k string, p string"), "k", "p", {"a": "n int, t string", "b": "n int"})
    assert [r["refused"] for r in got.collect()] == [None, "field n", "field n", "field n", "unknown type", "unknown type", "no object", "no object"]
