"""CSV files: encodings, headers, splits, guards."""

from __future__ import annotations

import pytest

from ledgerloom.sources import csv_files as C

EXPECTED = ["amount", "value_date", "narration"]


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([("INR", 1.0)], "currency string, rate_to_inr double")


def test_encodings_and_headers(spark, rates, tmp_path):
    rows = "Statement of Müller\nAmount;Value_Date;Narration\n1.50;2025-01-02;Café für ñ\n2.00;2025-01-03;x;y\n"
    (tmp_path / "a.csv").write_bytes(rows.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + rows.replace("Statement of Müller\n", "").encode("utf-8"))
    (tmp_path / "c.csv").write_bytes(rows.replace("ñ", "€").encode("cp1252"))
    (tmp_path / "d.csv").write_bytes(rows.encode("latin-1") + b"3.00;2025-01-04;odd \x81 byte\n")
    got = C.read_csv_rows(spark, str(tmp_path), "bank", EXPECTED, rates).collect()
    good = sorted(r["cells"]["narration"] for r in got if r["status"] == "loaded")
    assert good == sorted(["Café für ñ", "Café für ñ", "Café für €", "Café für ñ", "odd \x81 byte"])
    assert [r["reason"] for r in got if r["status"] == "failed"] == ["column_count"] * 4
    assert {r["amounts"]["amount"] for r in got if r["status"] == "loaded"} == {150, 300}


def test_a_file_in_many_splits(spark, rates, tmp_path):
    n = 3000
    (tmp_path / "big.csv").write_text("amount,value_date,narration\n" + "".join(f"{i}.00,2025-01-02,line {i}\n" for i in range(1, n + 1)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = C.read_csv_rows(spark, str(tmp_path), "bank", EXPECTED, rates)
        assert sorted(r["amounts"]["amount"] for r in got.collect()) == [100 * i for i in range(1, n + 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_guards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.csv").write_text("x,y\n" + "1,2\n" * 50)
    (tmp_path / "d.csv").write_text("x" * 500)
    (tmp_path / "e.csv").write_text("known\n")
    known = C.guard_files(spark, str(tmp_path / "e.csv")).select("content_hash")
    got = C.guard_files(spark, str(tmp_path), known, {"csv": 400}, 20).collect()
    assert {r["file"].rsplit("/", 1)[1]: r["refused"] for r in got} == {"a.csv": None, "b.csv": "duplicate", "c.csv": "too_many_rows", "d.csv": "too_large", "e.csv": "duplicate"}
