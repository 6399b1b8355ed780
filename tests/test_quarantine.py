"""Raw rows against a plain state machine, and the reader's corner cases."""

from __future__ import annotations

import datetime

import pytest

from ledgerloom.sources import quarantine as Q

CODES = [("INR", 1.0), ("USD", 84.1)]


def brute(line: str | None, header: str, source: str) -> str | None:
    """Reason, 'skipped' or None, by hand."""
    sep = max(Q.SEPARATORS, key=header.count)
    names = [n.strip().lower() for n in header.split(sep)]
    line = (line or "").removesuffix("\r")
    cells, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        cell += '"'
                        i += 2
                        continue
                    i += 1
                    break
                cell += line[i]
                i += 1
            if i < n and line[i] != sep:
                return "quoting"
        else:
            j = line.find(sep, i)
            j = n if j < 0 else j
            cell = line[i:j]
            if '"' in cell:
                return "quoting"
            i = j
        cells.append(cell)
        if i >= n:
            break
        i += 1
    if Q.is_skipped(cells):
        return "skipped"
    if len(cells) != len(names):
        return "column_count"
    row = {k: v.strip() for k, v in zip(names, cells)}

    def day(v: str):
        import re

        try:
            if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
                d = datetime.date.fromisoformat(v)
            elif re.fullmatch(r"\d{2}/\d{2}/\d{4}", v):
                d = datetime.date(int(v[6:]), int(v[3:5]), int(v[:2]))
            elif re.fullmatch(r"\d{10}|\d{13}", v):
                d = datetime.datetime.fromtimestamp(int(v[:10]), datetime.UTC).date()
            else:
                return False
        except ValueError:
            return False
        return datetime.date(2015, 1, 1) <= d <= datetime.date(2035, 1, 1)

    import re

    for group in (Q.MAIN_AMOUNTS, Q.MAIN_DATES):
        main = next((c for c in group if c in row), None)
        if main is None or not row[main]:
            return "value"
    for c in Q.AMOUNTS:
        tail = r"(\.\d{1,2})?" if source in ("bank", "ledger") else ""
        if row.get(c) and not re.fullmatch(r"[+-]?\d[\d,]*" + tail, row[c], re.ASCII):
            return "value"
    for c in Q.DATES:
        if row.get(c) and not day(row[c]):
            return "value"
    if row.get("currency") and row["currency"].upper() not in ("INR", "USD", "EUR", "GBP", "AED", "SGD"):
        return "value"
    return None


@pytest.mark.parametrize("scale", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_whole_table_against_brute_force(spark, scale):
    read = lambda t: spark.read.parquet(f"{scale}/{t}.parquet")
    got = {r["line_id"]: r for r in Q.classify_rows(read("raw_line"), read("source_file"), read("fx_rate"), block_rows=97).collect()}
    files = {r["file_hash"]: (r["header"], r["source"]) for r in read("source_file").where("header is not null").collect()}
    lines = read("raw_line").collect()
    assert len(got) == len(lines)
    for r in lines:
        want = brute(r["line"], *files[r["file_hash"]])
        have = got[r["line_id"]]
        assert (have["reason"] or ("skipped" if have["status"] == Q.STATUS_SKIPPED else None)) == want, r["line"]


HEADER = "order_id,order_total,order_date,remarks"
CASES = [
    ("a,1.00,2025-01-01,x", None),
    (None, "skipped"),
    ("", "skipped"),
    (",,,", "skipped"),
    ("Total,10.00,,", "skipped"),
    ('a,1.00,2025-01-01,"line\nbreak, and ""quote"""', None),
    ('a,1.00,2025-01-01,"open', "quoting"),
    ('a,1.00,2025-01-01,"shut" late', "quoting"),
    ('a,1.00,2025-01-01,in"side', "quoting"),
    ("a,1.00,2025-01-01", "column_count"),
    ("a,1.00,2025-01-01,x,y", "column_count"),
    ("a,1.005,2025-01-01,x", "value"),
    ("a,1.00,2025-02-30,x", "value"),
    ("a,1.00,,x", "value"),
    ("a,1.00,2025-01-01,x\r", None),
    ("a,1.00,2025-01-01," + "y" * 300_000, None),
    ("a,1.00,2025-01-01,after", None),
    ('a,1.00,2025-01-01,x,""', "column_count"),
    ("a,1.00,2025-01-01,x,", "column_count"),
    ('a,1.00,2025-01-01,""', None),
    ('a,1.00,2025-01-01,"a"b"c"', "quoting"),
    ('a,1.00,2025-01-01, "x"', "quoting"),
    ('"a,1.00","2025-01-01,x""', "quoting"),
    ('a,"1,234.50",31/12/2034,"x;y"', None),
    ('Total,,"10,5",', "skipped"),
]


def test_cases_repeated_rows_and_clashing_columns(spark):
    rows = [(i, "f", i, line, "clash") for i, (line, _) in enumerate(CASES)] + [(1000 + i, "f", 1000 + i, line, "clash") for i, (line, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows, "line_id bigint, file_hash string, line_no int, line string, header string")
    files = spark.createDataFrame([("f", HEADER, "ledger", 1)], "file_hash string, header string, source string, status int")
    fx = spark.createDataFrame(CODES, "currency string, rate_to_inr double")
    got = {r["line_id"]: r for r in Q.classify_rows(raw, files, fx).collect()}
    for i, (line, want) in enumerate(CASES):
        for k in (i, 1000 + i):
            assert (got[k]["reason"] or ("skipped" if got[k]["status"] == "skipped" else None)) == want, line
            assert got[k]["raw"] == line
    assert got[5]["cells"]["remarks"] == 'line\nbreak, and "quote"'
    assert got[0]["amounts"] == {"order_total": 100} and got[0]["dates"] == {"order_date": datetime.date(2025, 1, 1)}
    big = next(i for i, (x, _) in enumerate(CASES) if x and "1,234.50" in x)
    assert got[big]["amounts"] == {"order_total": 123450} and got[big]["dates"] == {"order_date": datetime.date(2034, 12, 31)}
    assert got[6]["amounts"] is None
    counted = {r["file_hash"]: r for r in Q.per_file(Q.classify_rows(raw, files, fx)).collect()}["f"]
    assert counted["rows_in"] == counted["rows_ok"] + counted["rows_quarantined"]


def test_rows_of_a_block_take_few_reads(monkeypatch):
    """However many rows are open or swallow others, a block is read a few times, not once a row."""
    import pandas as pd

    reader, reads = Q.BlockReader(["INR"]), []
    plain = reader._read
    monkeypatch.setattr(reader, "_read", lambda tags, *a: reads.append(len(tags)) or plain(tags, *a))
    lines = ['a,1.00,2025-01-01,"open', 'a,1.00,2025-01-01,"x"y"z"', "a,1.00,2025-01-01,fine"] * 300
    out = reader.read(pd.DataFrame({"line_id": range(900), "file_hash": "f", "line_no": range(900), "line": lines}), HEADER, "ledger")
    reader.close()
    assert out["reason"].tolist() == ["quoting", "quoting", None] * 300
    assert len(reads) < 10


def test_unknown_file_and_empty_table(spark):
    raw = spark.createDataFrame([(1, "g", 1, "a,b")], "line_id bigint, file_hash string, line_no int, line string")
    files = spark.createDataFrame([], "file_hash string, header string, source string")
    fx = spark.createDataFrame(CODES, "currency string, rate_to_inr double")
    assert Q.classify_rows(raw, files, fx).first()["reason"] == "column_count"
    assert Q.classify_rows(raw.limit(0), files, fx).count() == 0
