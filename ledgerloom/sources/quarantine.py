"""Reading raw delimited rows file by file, with the rows that cannot be read kept apart and explained.

Each worker hands the rows it holds of one file to DuckDB's CSV reader with reject tables, in blocks of bounded size, so
a file that holds a third of all rows is spread over many tasks. Every row is written behind a tag with its own
identity, so both typed rows and rejects lead back to the raw row they came from. The kind of a reject names the reason;
exact checks of the raw row follow where the reader is laxer than the rules.
"""

from __future__ import annotations

import bisect
import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import ship

#: Separators, markers of totals rows, and the columns that are checked by value.
SEPARATORS = [",", ";", "|", "\t"]
TOTALS = ["total", "grand total", "opening balance", "closing balance"]
AMOUNTS = ["amount", "order_total", "debit", "credit", "fee", "tax"]
MAIN_AMOUNTS = ["amount", "order_total"]
DATES = ["value_date", "posted_date", "order_date", "created_at", "settled_at"]
MAIN_DATES = ["value_date", "order_date", "settled_at"]
FIRST_DAY, LAST_DAY = "2015-01-01", "2035-01-01"

#: Rows per block: bounds both the reader's input and the worker's memory.
BLOCK_ROWS = 4000

STATUS_LOADED, STATUS_FAILED, STATUS_SKIPPED = "loaded", "failed", "skipped"

SCHEMA = T.StructType(
    [
        T.StructField("line_id", T.LongType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
        T.StructField("amounts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("dates", T.MapType(T.StringType(), T.DateType())),
    ]
)
#: What the reader's complaints say about a row.
REJECTS = {"UNQUOTED VALUE": "quoting", "MISSING COLUMNS": "column_count", "TOO MANY COLUMNS": "column_count"}
#: Most currency codes that are taken to the workers.
MOST_CODES = 100_000


def separator_of(header: str) -> str:
    """The separator that occurs most often in the header (first of the fixed list on a tie)."""
    return max(SEPARATORS, key=header.count)


def names_of(header: str, sep: str) -> list[str]:
    """Column names of a header: trimmed, unquoted, lower case; blanks become ``colN``, repeats get ``.n``."""
    seen: dict[str, int] = {}
    names = []
    for i, cell in enumerate(header.rstrip("\r\n").split(sep)):
        name = cell.strip().strip('"').strip().lower() or f"col{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name]}")
    return names


def row_grammar(sep: str) -> str:
    """A whole well-quoted row: cells without quote marks, or enclosed cells with doubled ones."""
    s = re.escape(sep)
    cell = f'(?:"(?:[^"]|"")*"|[^"{s}]*)'
    return f"{cell}(?:{s}{cell})*"


def loose_cells(line: str, sep: str) -> list[str]:
    """Cells of a well-quoted row of any width."""
    out, i = [], 0
    for m in re.finditer(f'(?:"((?:[^"]|"")*)"|([^"{re.escape(sep)}]*))(?:{re.escape(sep)}|$)', line):
        if m.start() < i or (m.start() == len(line) and out and not line.endswith(sep)):
            break
        out.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2) or "")
        i = m.end()
        if m.end() == len(line) and not line.endswith(sep):
            break
    return out


_NUMBER = re.compile(r"[+-]?[0-9][0-9,]*(?:\.[0-9]+)?")


def is_skipped(cells: list[str]) -> bool:
    """Blank rows, and rows that hold only numbers and at least one totals marker."""
    filled = [c.strip() for c in cells if c and c.strip()]
    if not filled:
        return True
    rest = [c for c in filled if c.lower() not in TOTALS]
    return len(rest) < len(filled) and all(_NUMBER.fullmatch(c) for c in rest)


def _cell(i: int) -> str:
    return f"trim(c{i}, e' \\t\\r\\n')"


def _day(c: str) -> str:
    return (
        f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({c} as date)"
        f" when regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_cast(right({c}, 4) || '-' || substr({c}, 4, 2) || '-' || left({c}, 2) as date)"
        f" when regexp_full_match({c}, '[0-9]{{10}}') then cast(make_timestamp(cast({c} as bigint) * 1000000) as date)"
        f" when regexp_full_match({c}, '[0-9]{{13}}') then cast(make_timestamp(cast({c} as bigint) * 1000) as date) end"
    )


def _typed(names: list[str], source: str) -> tuple[str, list[str], list[str]]:
    """SQL over the read columns ``c<i>``: what makes a row a failure by value, then its amounts and its dates.

    Amounts are whole minor units: bank and ledger write major ones. Null where the column is missing or empty.
    """
    at = {n: _cell(i) for i, n in reversed(list(enumerate(names)))}
    decimals = r"(\.[0-9]{1,2})?" if source in ("bank", "ledger") else ""
    bad, amounts, dates = [], [], []
    for group in (MAIN_AMOUNTS, MAIN_DATES):
        main = next((n for n in group if n in at), None)
        bad.append(f"coalesce({at[main]}, '') = ''" if main else "true")
    for n in AMOUNTS:
        if n in at:
            bad.append(f"(coalesce({at[n]}, '') <> '' and not regexp_full_match({at[n]}, '[+-]?[0-9][0-9,]*{decimals}'))")
            amounts.append(f"try_cast(try_cast(replace({at[n]}, ',', '') as decimal(30, 2)) * {100 if decimals else 1} as bigint)")
    for n in DATES:
        if n in at:
            bad.append(f"(coalesce({at[n]}, '') <> '' and coalesce({_day(at[n])} not between date '{FIRST_DAY}' and date '{LAST_DAY}', true))")
            dates.append(_day(at[n]))
    if "currency" in at:
        bad.append(f"(coalesce({at['currency']}, '') <> '' and upper({at['currency']}) not in (select code from codes))")
    return " or ".join(bad), amounts, dates


class BlockReader:
    """Reads blocks of rows of one file through DuckDB's CSV reader with reject tables."""

    def __init__(self, codes: list[str]):
        import duckdb

        self.con = duckdb.connect()
        self.con.execute("set threads = 1")
        self.con.execute("set memory_limit = '512MB'")
        self.con.execute("set timezone = 'UTC'")
        self.con.execute("create table codes as select unnest($1::varchar[]) as code", [sorted({c.strip().upper() for c in codes if c})])
        # The executor's own scratch folder; a block's file lives only while its task reads it.
        self.scratch = tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.count = 0

    def close(self) -> None:
        self.con.close()
        self.scratch.cleanup()

    def _read(self, tags: list[int], lines: list[str], names: list[str], sep: str) -> tuple[set[int], dict[int, str]]:
        """Fills table ``got`` (tag, c0..cn); returns the tags in it and the reader's complaints by tag."""
        self.count += 1
        path = os.path.join(self.scratch.name, f"block-{self.count}.csv")
        starts, at, longest = [], 0, 4096
        with open(path, "wb") as f:
            for tag, line in zip(tags, lines):
                row = f"{tag}{sep}{line}\n".encode("utf-8", "replace")
                starts.append(at)
                at += len(row)
                longest = max(longest, len(row))
                f.write(row)
        columns = "{" + ", ".join(["'tag': 'VARCHAR'", *(f"'c{i}': 'VARCHAR'" for i in range(len(names)))]) + "}"
        for t in ("got", "reject_scans", "reject_errors"):
            self.con.execute(f"drop table if exists {t}")
        self.con.execute(
            f"create temp table got as select try_cast(tag as bigint) as tag, * exclude (tag) from read_csv($path, auto_detect = false, header = false,"
            f" delim = '{sep}', quote = '\"', escape = '\"', columns = {columns}, strict_mode = true, null_padding = false, parallel = false,"
            f" store_rejects = true, rejects_limit = 0, max_line_size = {2 * longest}, buffer_size = {max(1 << 20, 40 * longest)})",
            {"path": path},
        )
        got = {r[0] for r in self.con.execute("select distinct tag from got where tag is not null").fetchall()}
        complaints: dict[int, str] = {}
        # Positions count from one; the raw row is the one that the position lies in.
        for start, kind in self.con.execute("select line_byte_position, error_type from reject_errors order by line_byte_position, byte_position").fetchall():
            complaints.setdefault(tags[bisect.bisect_right(starts, start - 1) - 1], str(kind))
        os.unlink(path)
        return got - complaints.keys(), complaints

    def read(self, rows: pd.DataFrame, header: str, source: str) -> pd.DataFrame:
        """Status, reason, cells and typed values for each of ``rows`` (line, one raw row each) of a file with ``header``."""
        sep = separator_of(header)
        names = names_of(header, sep)
        lines = [("" if x is None else x).removesuffix("\r") for x in rows["line"]]
        n = len(lines)
        reason: list[str | None] = [None] * n
        status = [STATUS_LOADED] * n
        cells: list[dict | None] = [None] * n
        amounts: list[dict | None] = [None] * n
        dates: list[dict | None] = [None] * n
        grammar = re.compile(row_grammar(sep))
        bad, amount_sql, date_sql = _typed(names, source)
        amount_names, date_names = [x for x in AMOUNTS if x in names], [x for x in DATES if x in names]
        typed = ", ".join([*amount_sql, *date_sql, f"({bad}) as bad"])
        # Each enclosed cell holds an even number of quote marks and no other cell any: an odd number is a fault, and a
        # row that would run on over its successors.
        open_rows = {i for i in range(n) if lines[i].count('"') % 2}
        for i in open_rows:
            reason[i] = "quoting"
        todo = [i for i in range(n) if i not in open_rows]

        def rejected(tag: int, kind: str | None) -> None:
            """The reason is the reader's; a fault of quoting comes first, which only rows with quote marks can have."""
            line = lines[tag]
            if '"' in line and not grammar.fullmatch(line):
                reason[tag] = "quoting"
            elif is_skipped(loose := loose_cells(line, sep)):
                status[tag] = STATUS_SKIPPED
            else:
                found = REJECTS.get(kind or "")
                reason[tag] = found if found and found != "quoting" else "column_count" if len(loose) != len(names) else "value"

        def one_pass(tags: list[int]) -> set[int]:
            got, complaints = self._read(tags, [lines[t] for t in tags], names, sep)
            done = set(complaints)
            k, m = len(names), len(names) + len(amount_names)
            for tag, *row in self.con.execute(f"select *, {typed} from got").fetchall():
                if tag not in got or tag in done:
                    continue
                done.add(tag)
                line, read = lines[tag], ["" if v is None else v for v in row[:k]]
                # It lets a quote mark pass inside a cell that is not enclosed, and an empty cell too many at the end.
                if '"' in line and not grammar.fullmatch(line):
                    reason[tag] = "quoting"
                elif is_skipped(read):
                    status[tag] = STATUS_SKIPPED
                elif line.endswith((sep, '""')) and len(loose_cells(line, sep)) != k:
                    reason[tag] = "column_count"
                elif row[-1]:
                    reason[tag] = "value"
                else:
                    cells[tag] = dict(zip(names, read))
                    amounts[tag], dates[tag] = dict(zip(amount_names, row[k:m])), dict(zip(date_names, row[m:-1]))
            for tag, kind in complaints.items():
                rejected(tag, kind)
            return done

        # Rows that a faulty one before them swallowed are read again without it.
        while todo:
            done = one_pass(todo)
            rest = [i for i in todo if i not in done]
            if len(rest) == len(todo):
                for i in rest:
                    if '"' in lines[i] and not grammar.fullmatch(lines[i]) or i not in one_pass([i]):
                        rejected(i, None)
                break
            todo = rest
        status = [STATUS_FAILED if r else s for r, s in zip(reason, status)]
        good = [s == STATUS_LOADED for s in status]
        return pd.DataFrame(
            {
                "line_id": rows["line_id"].array,
                "file_hash": rows["file_hash"].array,
                "line_no": rows["line_no"].array,
                "status": status,
                "reason": reason,
                "raw": rows["line"].array,
                **{name: [c if g else None for c, g in zip(values, good)] for name, values in (("cells", cells), ("amounts", amounts), ("dates", dates))},
            }
        )


def classify_rows(raw_line: DataFrame, source_file: DataFrame, fx_rate: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every raw row with ``status`` (loaded, failed, skipped), ``reason`` of a failure and, when loaded, its ``cells`` as
    text and typed: ``amounts`` in minor units and ``dates``, by column name.

    Nulls and edge cases: a null line counts as blank and is skipped; rows of a file without a known header fail with
    ``column_count``; repeated rows are each judged; texts of any length are read whole; empty tables give no rows;
    extra columns of the inputs are ignored, but for ``part``, which says where ``line_no`` begins anew. ``fx_rate`` (one row per currency code) is a dimension collected to the
    driver: at most a few hundred ISO codes.
    """
    ship(raw_line.sparkSession)
    codes = [r[0] for r in fx_rate.select("currency").where("currency is not null").distinct().limit(MOST_CODES + 1).collect()]
    if len(codes) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} currency codes")
    files = source_file.select(F.col("file_hash"), F.col("header").alias("_header"), F.col("source").alias("_source")).where("header is not null")
    part = F.col("part").cast("bigint") if "part" in raw_line.columns else F.lit(0).cast("bigint")
    lines = raw_line.select("line_id", "file_hash", F.col("line_no").cast("int").alias("line_no"), "line", part.alias("_part"))
    # Blocks of one file: bounded by the row number, so a hot file is spread over many tasks.
    placed = lines.join(files, "file_hash", "left").withColumn("_block", F.floor(F.coalesce("line_no", F.lit(0)) / block_rows))
    placed = placed.repartition("file_hash", "_part", "_block").sortWithinPartitions("file_hash", "_part", "_block", "line_no", "line_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = BlockReader(codes)
        try:
            for batch in batches:
                known = batch["_header"].notna()
                for _, rows in batch[known].groupby(["file_hash", "_part", "_block"], sort=False):
                    for k in range(0, len(rows), block_rows):
                        part = rows.iloc[k : k + block_rows]
                        yield reader.read(part.reset_index(drop=True), part["_header"].iloc[0], part["_source"].iloc[0])
                if (~known).any():
                    rest = batch[~known]
                    yield pd.DataFrame(
                        {
                            "line_id": rest["line_id"].array,
                            "file_hash": rest["file_hash"].array,
                            "line_no": rest["line_no"].array,
                            "status": STATUS_FAILED,
                            "reason": "column_count",
                            "raw": rest["line"].array,
                            "cells": None,
                            "amounts": None,
                            "dates": None,
                        }
                    )
        finally:
            reader.close()

    return placed.mapInPandas(run, SCHEMA)


def quarantined(classified: DataFrame) -> DataFrame:
    """RowQuarantined: the failed rows with the reason and the raw text."""
    return classified.where(F.col("status") == STATUS_FAILED).select("line_id", "file_hash", "line_no", "reason", "raw")


def loaded(classified: DataFrame) -> DataFrame:
    """The loadable rows: ``cells`` maps the file's column names to text, ``amounts`` and ``dates`` to typed values."""
    return classified.where(F.col("status") == STATUS_LOADED).select("line_id", "file_hash", "line_no", "cells", "amounts", "dates")


def per_file(classified: DataFrame) -> DataFrame:
    """SourceIngested: rows read, loaded and quarantined per file; skipped rows are not counted in rows_in."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return (
        classified.where(F.col("status") != STATUS_SKIPPED)
        .groupBy("file_hash")
        .agg(F.count(F.lit(1)).alias("rows_in"), count(F.col("status") == STATUS_LOADED).alias("rows_ok"), count(F.col("status") == STATUS_FAILED).alias("rows_quarantined"))
    )
